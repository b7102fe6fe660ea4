"""Document fingerprints by winnowing, in DataFrame functions only.

A text is read as pieces: words, and words over 16 characters in runs of 16. Each run of ``k`` pieces
has a rolling hash; of every ``window`` neighbouring hashes the smallest is chosen, the rightmost among
equals, and kept with its position. Two texts that share ``k + window - 1`` pieces in a row therefore
share a chosen hash (the match guarantee). A chosen hash and its position travel as one long, the
hash above and the position counted down below, so that the least long is the least hash and, among
equals, the rightmost. Window minima come from minima of 1, 2, 4, ... by doubling.

The next document is found on ids alone: ids are range-partitioned, each takes its successor within its
partition, and the last of a partition takes the first of the next, so no task sees all ids. Texts move
once by id; of the next document only the characters asked for and its hashes move.

Edge cases. A null text is read as an empty one, which has no hash; two texts without hashes have likeness
1, one without has 0 with any other. Fewer than ``k`` pieces count as one run. Rows without an id come first in the
order. Where an id is repeated, each of its rows is edited with the next greater id, and the least text of
that id serves. One document alone is its own next. Extra columns are not read; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workdir import cut, shuffle_partitions

K_PIECES = 3
WINDOW = 4
PIECE = r"[^\x20\x09-\x0D]{1,16}"
_LOW = (1 << 31) - 1


def _least_with(array: str, step: int) -> Column:
    """Each element or the one ``step`` later, whichever is less."""
    return F.transform(F.col(array), lambda x, i: F.least(x, F.get(F.col(array), i + step)))


def with_fingerprint(df: DataFrame, text: str, into: str, k: int = K_PIECES, window: int = WINDOW) -> DataFrame:
    """``df`` with the chosen (hash, position) longs of a text column, in order of position."""
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    h, v, m = f"_{into}_h", f"_{into}_v", f"_{into}_m"
    df = df.withColumn(h, F.transform(F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0)), lambda w: F.hash(w)))
    n = F.size(h)
    gram = F.transform(F.col(h), lambda x, i: F.shiftleft(F.hash(x, *(F.get(F.col(h), i + j) for j in range(1, k))).cast("long"), 32) + (F.lit(_LOW) - i).cast("long"))
    short = F.array(F.shiftleft(F.hash(F.col(h)).cast("long"), 32) + F.lit(_LOW).cast("long"))
    df = df.withColumn(v, F.when(n == 0, F.array().cast("array<long>")).when(n < k, short).otherwise(F.slice(gram, F.lit(1), F.greatest(n - (k - 1), F.lit(0)))))
    step, now = 1, v
    while step < window:
        df = df.withColumn(f"{m}{step}", _least_with(now, step))
        now, step = f"{m}{step}", step * 2
    full = F.size(v) - (window - 1)
    picks = F.when(full >= 1, F.array_distinct(F.slice(F.col(now), F.lit(1), F.greatest(full, F.lit(1))))).when(F.size(v) > 0, F.array(F.array_min(F.col(v)))).otherwise(F.col(v))
    return df.withColumn(into, picks).drop(h, v, *(c for c in df.columns if c.startswith(m)))


def hashes(fingerprint: str) -> Column:
    """The set of chosen hashes."""
    return F.array_distinct(F.transform(F.col(fingerprint), lambda x: F.shiftright(x, 32).cast("int")))


def shown(fingerprint: str) -> Column:
    """hash:position of each choice, in order."""
    return F.concat_ws(" ", F.transform(F.col(fingerprint), lambda x: F.concat(F.shiftright(x, 32).cast("string"), F.lit(":"), (F.lit(_LOW).cast("long") - x.bitwiseAND(F.lit((1 << 32) - 1))).cast("string"))))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both.cast("double") / F.greatest(union, F.lit(1)))


def successors(docs: DataFrame) -> DataFrame:
    """(ord, half, next, prev, prev_half) of each id: half is half of its length, next and prev wrap around."""
    n = shuffle_partitions(docs.sparkSession)
    ids = docs.groupBy("ord").agg(F.max(F.length("text")).alias("n"))
    ranged = cut(ids.repartitionByRange(n, "ord").select("ord", F.floor(F.col("n") / 2).cast("int").alias("half"), F.spark_partition_id().alias("part")))
    ends = ranged.groupBy("part").agg(F.min("ord").alias("first"))
    head = ends.select(F.min("first")).first()[0]
    after = ends.select("part", F.lead("first").over(Window.orderBy("part")).alias("following"))
    linked = (
        ranged.join(F.broadcast(after), "part")
        .select("ord", "half", F.coalesce(F.lead("ord").over(Window.partitionBy("part").orderBy("ord")), "following", F.lit(head)).alias("next"))
    )
    back = linked.select(F.col("next").alias("ord"), F.col("ord").alias("prev"), F.col("half").alias("prev_half"))
    return cut(linked.join(back, "ord"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("ord"))
    placed = own.join(successors(own), "ord")
    # The window asks for the same columns as the join below, so that both read one exchange of texts.
    given = placed.withColumn("rn", F.row_number().over(Window.partitionBy("ord").orderBy("text", "doc_id"))).where("rn = 1")
    given = with_fingerprint(given, "text", "fp").select(F.col("prev").alias("ord"), F.substring("text", F.lit(1), F.col("prev_half")).alias("tail"), hashes("fp").alias("next_set"))
    n = F.length("text")
    joined = placed.select("ord", "doc_id", "text").join(given, "ord")
    both = joined.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "text",
        F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), F.substring("tail", F.lit(1), F.floor(n / 2).cast("int"))).alias("edited"),
        "next_set",
    )
    both = with_fingerprint(with_fingerprint(both, "text", "fp"), "edited", "edited_fp")
    sets = both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", "edited_fp", "next_set", hashes("fp").alias("own_set"), hashes("edited_fp").alias("edited_set"))
    return sets.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown("fp").alias("fingerprint"),
        shown("edited_fp").alias("edited_fingerprint"),
        likeness("own_set", "edited_set").alias("near_edited"),
        likeness("own_set", "next_set").alias("near_next"),
    )
