"""Names of queries, the functions that run them, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with SQL where it can be told in SQL."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, with no negative zero, so that results compare across engines."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _load() -> None:
    from . import kernel_queries, moment_queries  # noqa: F401


def registered_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def registered_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered_queries()["realized_measures"](spark, sf_dir)
