"""Series made from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, y): revenue by day of shipping."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(F.to_date("l_shipdate").alias("t")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"))


DAILY = "SELECT CAST(l_shipdate AS DATE) AS t, sum(l_extendedprice * (1 - l_discount)) AS y FROM lineitem GROUP BY 1"


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, y, n, a): orders by month, in millions; how many; the average in thousands."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.trunc("o_orderdate", "month").alias("t")).agg(
        (F.sum("o_totalprice") / 1e6).alias("y"), F.count(F.lit(1)).cast("double").alias("n"), (F.avg("o_totalprice") / 1e3).alias("a")
    )


MONTHLY = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS t, sum(o_totalprice) / 1e6 AS y, CAST(count(*) AS DOUBLE) AS n, avg(o_totalprice) / 1e3 AS a FROM orders GROUP BY 1"


def type_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, t, y, x): events by type and day: the average value, and how many."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("g"), F.to_date("ts").alias("t")).agg(F.avg("value").alias("y"), F.count(F.lit(1)).cast("double").alias("x"))


TYPE_DAYS = "SELECT event_type AS g, CAST(ts AS DATE) AS t, avg(value) AS y, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY 1, 2"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, t, high, low, open, close) of event values by type and day."""
    e = table(spark, sf_dir, "events")
    at = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("g"), F.to_date("ts").alias("t")).agg(
        F.max("value").alias("high"), F.min("value").alias("low"), F.min_by("value", at).alias("open"), F.max_by("value", at).alias("close")
    )


BARS = (
    "SELECT event_type AS g, CAST(ts AS DATE) AS t, max(value) AS high, min(value) AS low, "
    "arg_min(value, (ts, event_id)) AS open, arg_max(value, (ts, event_id)) AS \"close\" FROM events GROUP BY 1, 2"
)


def user_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, t, y): a user's event values in order of time."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("g"), F.struct("ts", "event_id").alias("t"), F.col("value").alias("y"))


USER_VALUES = "SELECT user_id AS g, (ts, event_id) AS t, value AS y FROM events"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, m, r): daily log changes of revenue, with their month."""
    from pyspark.sql import Window

    w = Window.orderBy("t")
    d = daily(spark, sf_dir).select("t", F.log("y").alias("l"))
    return d.select("t", F.trunc("t", "month").alias("m"), (F.col("l") - F.lag("l").over(w)).alias("r")).where("r IS NOT NULL")


RETURNS = f"SELECT t, CAST(date_trunc('month', t) AS DATE) AS m, r FROM (SELECT t, ln(y) - lag(ln(y)) OVER (ORDER BY t) AS r FROM ({DAILY})) WHERE r IS NOT NULL"


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, y, c, x1, x2): price against quantity and discount of the lines of an order month."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy(F.to_date("l_shipdate").alias("t")).agg(
        (F.avg("l_extendedprice") / 1e3).alias("y"), F.lit(1.0).alias("c"), F.avg("l_quantity").alias("x1"), (F.avg("l_discount") * 100).alias("x2")
    )


REGRESSION = "SELECT CAST(l_shipdate AS DATE) AS t, avg(l_extendedprice) / 1e3 AS y, 1.0::DOUBLE AS c, avg(l_quantity) AS x1, avg(l_discount) * 100 AS x2 FROM lineitem GROUP BY 1"
