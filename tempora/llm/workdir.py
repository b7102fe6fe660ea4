"""Where the operators of this subpackage keep what they cut their lineage with."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder, as in tests.
DEFAULT_DIR = "/tmp/checkpoints/tempora"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's own setting wherever there is one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    context.setCheckpointDir(named or DEFAULT_DIR)
    return named or DEFAULT_DIR


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session with some settings (dots written as __) for what is run inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: What is kept in the shared folder is read from there, so the shuffles that made it are deleted at once.
DROP_SHUFFLES = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    checkpoint_dir(df.sparkSession)
    with settings(df.sparkSession, **DROP_SHUFFLES):
        return df.select("*").checkpoint(eager=True)


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by a key and kept so that Spark still knows how it is dealt: later joins on the key leave it in place.

    A plan under adaptive execution does not tell its partitioning when it is kept, so this one is planned without.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    with settings(spark, spark__sql__adaptive__enabled="false", **DROP_SHUFFLES):
        return df.repartition(shuffle_partitions(spark), key).checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Tables written in the shared folder while an operator runs.

    A table that is read back is a plan of its own, without what led to it, so rounds of an iteration
    cost the driver nothing that adds up. What the result does not read is deleted by ``close``.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._root = f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
        self._paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self._root}/{len(self._paths)}"
        with settings(self._spark, **DROP_SHUFFLES):
            df.select("*").write.parquet(path)
        self._paths.append(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete what these read; nothing else may read it."""
        for path in {p for t in tables for p in self._read_by(t)}:
            self._delete(path)

    def close(self, *results: DataFrame) -> None:
        """Delete all tables but those that the results read."""
        used = {p for r in results for p in self._read_by(r)}
        for path in list(self._paths):
            if path and path not in used:
                self._delete(path)

    def _read_by(self, df: DataFrame) -> set[str]:
        files = df.inputFiles()
        return {p for p in self._paths if p and any(f"{p.partition(':')[2] or p}/" in f for f in files)}

    def _delete(self, path: str) -> None:
        jvm = self._spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self._paths[self._paths.index(path)] = ""
