"""Mixing sources to target weights by temperature.

A source's share of the tokens (words) is raised to an exponent and normalised: 1 keeps the shares, 0 makes sources equal, more than 1 favours large ones. The
exponent is bisected to the least that meets the limits given: an entropy of the weights of at most ``entropy`` (a share of the greatest possible), or
no source repeated more than ``repeat_limit`` times; limits that no exponent meets raise. Budgets are the weights times a number of tokens; by default the least number with
which every source has one whole pass, so nothing is lost by mixing and the source with the largest share is passed once.

A source's budget is realised as passes over a block permutation: its documents fall into blocks by a seeded hash, each pass visits the
blocks in another order and the documents of a block in another order, whole passes first, and of the last pass the documents whose tokens before them
are within what is left. Block sums give each block its first token, and only the documents of one block are put in order together, so a source
that holds a third of all rows is many tasks. ``place``, from 0 to 1, is how far through its source's budget a row's block comes: rows in order of (place, position) are
the mix, with every source spread evenly over it (``mixed`` gives them in that order).

Edge cases. A null source is a source of its own; a null or wordless text counts one token, so that it has a place. Repeated rows are each
a row of the source and are drawn one by one, in one block where they share id and text. One source, or an empty table, gives its rows once (or none). More than ``MOST_SOURCES``
sources raise. Extra columns travel along; names that clash with those added raise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workdir import cut


#: Sources at most: the exponent is solved on the driver, and the plan, a row of a few numbers a source, is broadcast.
MOST_SOURCES = 100_000
#: The largest exponent tried.
STEEPEST = 64.0


@dataclass(frozen=True)
class MixingParams:
    repeat_limit: float | None = 1.5
    entropy: float | None = None
    #: Tokens to realise; None: the least that passes every source once.
    budget: int | None = None
    block_tokens: int = 1 << 20
    seed: int = 15


def weights(shares: dict, exponent: float) -> dict:
    top = max(shares.values())
    raised = {s: (x / top) ** exponent for s, x in shares.items()}
    total = sum(raised.values())
    return {s: x / total for s, x in raised.items()}


def passes(shares: dict, w: dict) -> dict:
    """How often each source is passed when the budget is the least that passes all once."""
    least = min(w[s] / shares[s] for s in shares)
    return {s: w[s] / shares[s] / least for s in shares}


def solve_exponent(shares: dict, p: MixingParams) -> float:
    """The least exponent within the limits, by bisection. A limit of repeats holds from some exponent on up to 1, one of entropy from some on; raises where none does."""
    total = sum(shares.values())

    def fits(exponent: float) -> bool:
        w = weights(shares, exponent)
        if p.repeat_limit is not None:
            often = passes(shares, w) if p.budget is None else {s: p.budget * w[s] / shares[s] for s in shares}
            if max(often.values()) > p.repeat_limit + 1e-12:
                return False
        if p.entropy is not None and len(shares) > 1:
            return -sum(x * math.log(x) for x in w.values() if x > 0) / math.log(len(shares)) <= p.entropy + 1e-12
        return True

    if not total:
        return 1.0
    if len(shares) > 1 and fits(0.0):
        return 0.0
    high = 1.0
    while not fits(high):
        if high >= STEEPEST or len(shares) == 1:
            raise ValueError("no exponent meets the limits of repeats and entropy with this budget")
        high *= 2
    low = 0.0
    for _ in range(60 if len(shares) > 1 else 0):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def tokens():
    """Words of the text; one at least."""
    return F.greatest(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)), F.lit(1)).cast("long")


ADDED = ("weight", "pass", "block", "position", "place")


def mix(docs: DataFrame, p: MixingParams = MixingParams()) -> DataFrame:
    """``docs`` as mixed: one row for each time that a document is drawn, with weight, pass, place and the orders of its block and within it."""
    if clash := set(ADDED) & set(docs.columns):
        raise ValueError(f"the table already has columns {sorted(clash)}")
    sourced = docs.withColumn("_source", F.coalesce("source", F.lit("\0none")))
    sizes = sourced.groupBy("_source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("n")).limit(MOST_SOURCES + 1).collect()
    if not sizes:
        return docs.withColumns({"weight": F.lit(0.0), "pass": F.lit(0), "block": F.lit(0).cast("long"), "position": F.lit(0).cast("long"), "place": F.lit(0.0)}).limit(0)
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    spark = docs.sparkSession
    split = spark.createDataFrame([(r["_source"], -(-r["n"] // (8 * p.block_tokens))) for r in sizes], "_source string, _blocks long")
    blocked = sourced.join(F.broadcast(split), "_source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(p.seed)), F.col("_blocks"))).drop("_blocks")
    # Tokens are counted once, by block; a source's total is the sum over its blocks.
    sums = cut(blocked.groupBy("_source", "block").agg(F.sum(tokens()).alias("t")))
    totals = {r["_source"]: r["t"] for r in sums.groupBy("_source").agg(F.sum("t").alias("t")).collect()}
    w = weights(totals, solve_exponent(totals, p))
    whole = p.budget if p.budget is not None else max(totals[s] / w[s] for s in totals)
    budgets = {s: round(whole * w[s]) for s in totals}
    plan = [(s, float(w[s]), int(budgets[s] // t), int(budgets[s] % t), budgets[s] / t) for s, t in totals.items()]
    plan_df = F.broadcast(spark.createDataFrame(plan, "_source string, weight double, _full int, _rest long, _times double"))
    last_order = F.xxhash64("block", "_full", F.lit(p.seed + 1))
    by_source = Window.partitionBy("_source").orderBy(last_order, "block")
    before = sums.join(plan_df, "_source").where("_rest > 0").withColumn("_before", F.sum("t").over(by_source) - F.col("t"))
    partial = before.where("_before < _rest").select("_source", "block", "_before", (F.col("_before") + F.col("t") <= F.col("_rest")).alias("_whole"))
    partial = cut(partial)
    placed = blocked.join(plan_df, "_source")
    columns = [*docs.columns, "_source", "block", "weight", "_full", "_rest", "_times"]
    inner = F.xxhash64("doc_id", F.xxhash64("text"), "_full", F.lit(p.seed + 2))
    # The one block of a source that the last pass ends in, one row a source: its rows are put in order and drawn one by one.
    ends = F.broadcast(partial.where("NOT _whole").select("_source", "block", "_before"))
    running = Window.partitionBy("_source", "block").orderBy("_h", "doc_id", F.xxhash64(*docs.columns)).rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.join(ends, ["_source", "block"]).withColumn("_h", inner).withColumn("_ahead", F.col("_before") + F.coalesce(F.sum(tokens()).over(running), F.lit(0)))
    edge = edge.select(*columns, (F.col("_ahead") < F.col("_rest")).cast("int").alias("_extra"))
    others = placed.join(ends, ["_source", "block"], "left_anti").join(partial.where("_whole").select("_source", "block", F.lit(1).alias("_extra")), ["_source", "block"], "left")
    drawn = others.select(*columns, F.coalesce("_extra", F.lit(0)).alias("_extra")).union(edge)
    times = F.col("_full") + F.col("_extra")
    rows = drawn.where(times > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), times - 1)))
    order = F.xxhash64("block", "pass", F.lit(p.seed + 1))
    within = F.xxhash64("doc_id", F.xxhash64("text"), "pass", F.lit(p.seed + 2))
    through = F.least((F.col("pass") + order / F.lit(2.0**64) + 0.5) / F.col("_times"), F.lit(1.0))
    return rows.select(*docs.columns, "weight", F.col("pass").cast("int").alias("pass"), order.alias("block"), within.alias("position"), through.alias("place"))


def mixed(docs: DataFrame, p: MixingParams = MixingParams()) -> DataFrame:
    """The rows of ``mix`` in their order, without the columns added: dealt by range, so files written of it follow one another."""
    order = ["place", "position"]
    return mix(docs, p).repartitionByRange(*order).sortWithinPartitions(*order, "doc_id").select(*docs.columns)


def mixing_report(docs: DataFrame, p: MixingParams = MixingParams()) -> DataFrame:
    """One row for each draw: doc_id, source, weight, pass, block, position, place (rows in order of pass, block and position are a source's permutation, in order of place and position the mix)."""
    return mix(docs.select("doc_id", "text", "source"), p).select("doc_id", "source", "weight", "pass", "block", "position", "place")
