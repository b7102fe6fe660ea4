"""Labelled rows for the classifiers: a bounded sample, read without moving the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of the remainders of crc32(doc_id as text) modulo 4, the one whose labels are never learnt from.
HELD_OUT = 2
#: Of the others, the one that classifiers are calibrated on.
CALIBRATION = 3


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4; 0 where there is no id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)), F.lit(0)).cast("int")


def labelled_ids(labels: DataFrame, label: str, max_rows: int, seed: int) -> DataFrame:
    """(doc_id, label, fold, order) of at most ``max_rows`` labelled ids outside the held-out fold, chosen by hash of the id over all labels.

    Labels that are null or not 0 or 1 are not used, nor those of an id that is labelled both ways."""
    return (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .drop("other")
        .withColumn("fold", fold())
        .where(F.col("fold") != HELD_OUT)
        .withColumn("order", F.xxhash64("doc_id", F.lit(seed)))
        .orderBy("order", "doc_id")
        .limit(max_rows)
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, seed: int) -> DataFrame:
    """(order, fold, label, text) of the ids of ``labelled_ids``: one row an id, with the least of its texts.

    The sample has ``max_rows`` rows of an id, an integer and a label at most, so it is broadcast; only its texts move.
    """
    picked = labelled_ids(labels, label, max_rows, seed)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "order", "fold", "label").agg(F.min("text").alias("text")).select("order", "fold", "label", "text")
