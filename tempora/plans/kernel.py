"""Grouped kernels: one numpy function over each key's ordered arrays, and replications over seeds.

A kernel takes arrays (one for a column name, a matrix for a list of names) and options, and returns a dict of
scalars, strings, vectors, matrices or cubes. Results are rows (key columns, field, i, j, k, value, note): scalars
have no index, vectors i, matrices i and j, cubes all three; strings are notes; what is not finite is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "field string, i int, j int, k int, value double, note string"


def flatten(result: dict, prefix: str = "") -> list[tuple]:
    rows: list[tuple] = []
    for name, value in result.items():
        field = f"{prefix}{name}"
        if value is None:
            rows.append((field, None, None, None, None, None))
        elif isinstance(value, str):
            rows.append((field, None, None, None, None, value))
        elif isinstance(value, dict):
            rows += flatten(value, f"{field}.")
        elif isinstance(value, (list, tuple)) and value and isinstance(value[0], dict):
            for i, one in enumerate(value):
                rows += flatten(one, f"{field}[{i}].")
        elif isinstance(value, (list, tuple)) and value and isinstance(value[0], str):
            rows += [(field, i, None, None, None, v) for i, v in enumerate(value)]
        else:
            array = np.asarray(value, float)
            if array.ndim == 0:
                rows.append((field, None, None, None, float(array), None))
            else:
                if array.ndim > 3:
                    array = array.reshape(array.shape[0], array.shape[1], -1)
                for at in np.ndindex(array.shape):
                    rows.append((field, *at, *(None,) * (3 - len(at)), float(array[at]), None))
    return [(f, i, j, k, v if v is not None and np.isfinite(v) else None, note) for f, i, j, k, v, note in rows]


def columns_of(args: Iterable) -> list[str]:
    return list(dict.fromkeys(c for a in args for c in ([a] if isinstance(a, str) else a)))


def check_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing[0]!r}; the table has {df.columns}")


def grouped(df: DataFrame, kernel: Callable[..., dict], args: Sequence, time: str, key: Sequence[str] = (), allow_missing: bool = False, **options) -> DataFrame:
    """The kernel's results for each key, each key's rows in the order of ``time``.

    A key's rows are one task's; many keys make many tasks. Missing values raise unless the kernel takes them.
    """
    key = list(key)
    names = columns_of(args)
    check_columns(df, [*key, time, *names])
    name = kernel.__name__

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_t", kind="stable")
        arrays = [frame[a].to_numpy(float) if isinstance(a, str) else frame[list(a)].to_numpy(float) for a in args]
        if not allow_missing and any(not np.isfinite(a).all() for a in arrays):
            raise ValueError(f"{name}: the series has missing or infinite values; drop or fill them first")
        rows = flatten(kernel(*arrays, **options))
        out = pd.DataFrame(rows, columns=["field", "i", "j", "k", "value", "note"])
        for c in ("i", "j", "k"):
            out[c] = out[c].astype("Int32")
        for at, c in enumerate(key):
            out.insert(at, c, frame[c].iloc[0])
        return out

    picked = df.select(*key, F.col(time).alias("_t"), *(F.col(c).cast("double").alias(c) for c in names if c not in key))
    kinds = dict(df.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in key) + RESULT
    return picked.groupBy(*key).applyInPandas(run, schema) if key else picked.groupBy(F.lit(0).alias("_all")).applyInPandas(run, schema)


def result_frame(spark: SparkSession, result: dict) -> DataFrame:
    """A driver-side result in the same shape."""
    rows = [(f, *(None if x is None else int(x) for x in (i, j, k)), v, n) for f, i, j, k, v, n in flatten(result)]
    return spark.createDataFrame(rows, RESULT)


def replicate(spark: SparkSession, count: int, seed: int, body: Callable[[np.random.Generator, int], dict], tasks: int | None = None) -> DataFrame:
    """(rep, field, i, j, k, value, note) of ``count`` replications.

    Replication i draws from child i of the seed's sequence (Philox), whichever task runs it, so results do not depend on
    how replications are dealt.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            parts = []
            for i in frame["id"]:
                rng = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed, spawn_key=(int(i),))))
                part = pd.DataFrame(flatten(body(rng, int(i))), columns=["field", "i", "j", "k", "value", "note"])
                part.insert(0, "rep", int(i))
                parts.append(part)
            out = pd.concat(parts) if parts else pd.DataFrame(columns=["rep", "field", "i", "j", "k", "value", "note"])
            for c in ("i", "j", "k"):
                out[c] = out[c].astype("Int32")
            yield out

    tasks = tasks or min(count, spark.sparkContext.defaultParallelism)
    return spark.range(0, count, 1, tasks).mapInPandas(run, f"rep long, {RESULT}")
