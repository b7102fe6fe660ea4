"""Quality classifier by importance resampling (ratio of generative models, Gumbel top-k).

Two bag-of-n-grams models over hashed words and pairs of words: one of the target (a bounded sample by hash of the texts
labelled good, outside the held-out and the calibration fold), one of the raw text, counted over all documents. The hash table has a slot for every
``slot_grams`` n-grams of the corpus (2 ** ``bits`` at least), so as much shares a slot in a large corpus as in a small one. No task holds the table:
blocks of documents send their own slots' counts to buckets and get the slots' log ratios over all blocks back, in steps of 1 / ``STEPS`` (see ``blocks``). The
target's counts are smoothed by the raw model: a slot gets ``smooth`` target tokens in the raw proportions, so a slot that the labels say nothing about has ratio 1.

A text's log weight is the sum of its n-grams' log ratios. The sample has k texts, drawn without replacement by the Gumbel trick: the k greatest of log
weight per n-gram / ``temperature`` + Gumbel noise from a hash of the id. The weight is taken per n-gram since the sum grows with the length, whichever model is
the better one (README has figures of both). k is a parameter; without it, k is the number of documents whose log weight per n-gram is at the floor that parts good from bad best on the labels of
the calibration fold, where a good text lost counts as ``good_cost`` bad ones kept. The k-th greatest key is found by a radix search over counts of 16 bits of it at a time, whatever the
number of rows.

Edge cases. A null or wordless text has log ratio 0. Rows with equal ids and texts share their key, hence their fate; keys
equal to the k-th are all selected. An id labelled both ways counts as not labelled. Without good labels the ratio is 1 everywhere; without a bad one in the calibration
fold there is no floor; either way all are selected unless k is given. An id that is not a whole number raises. Empty tables give empty results. Extra columns travel along in ``resample``; names that
clash with those added raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textkern as K
from .training import CALIBRATION, labelled_ids
from .workdir import cut


@dataclass(frozen=True)
class ResamplingParams:
    bits: int = 16
    #: N-grams of the corpus for a slot of the table, where it has more than 2 ** bits.
    slot_grams: int = 12
    smooth: float = 0.2
    #: How many to select; None: as many as are above the calibrated floor.
    k: int | None = None
    good_cost: float = 2.0
    temperature: float = 0.02
    #: The bound of the sample of labelled texts; its good ones outside the calibration fold are the target, the fold gives the floor.
    max_labelled_rows: int = 30_000
    seed: int = 14

    def __post_init__(self):
        if not 1e-4 <= self.temperature:
            raise ValueError("the temperature must be 1e-4 at least, so that keys keep their order as whole numbers")


#: Steps of a log ratio; a slot's answer is one signed byte of them.
STEPS = 12


def ngrams(data: np.ndarray, offsets: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every word and every pair of neighbours."""
    starts, ends, first = K.runs(K.NONSPACE[data], offsets)
    word, text = K.RangeHash(data)(starts, ends), K.owners(first)
    pair = np.flatnonzero(text[1:] == text[:-1])
    both = np.concatenate([word, K.mix(word[pair] * np.uint64(0x632BE59BD9B4E019) + word[pair + 1])])
    return np.concatenate([text, text[pair]]), both % np.uint64(slots)


@dataclass(frozen=True)
class Model:
    """The sizes of both models; the counts of slots are in the answers to the blocks."""

    slots: int
    raw: int
    target: int

    def ratios(self, raw: np.ndarray, target: np.ndarray, smooth: float) -> np.ndarray:
        """The log ratio of slots with these counts, in steps; those beyond 127 of them (10.6) are not told apart."""
        share = raw * self.target / self.raw
        ratio = np.log((target + smooth * share + 0.5) / ((1 + smooth) * share + 0.5))
        return np.clip(np.rint(ratio * STEPS), -127, 127).astype(np.int8)

    def place(self, slot: np.ndarray) -> np.ndarray:
        """The 48-bit key of a slot, for blocks' buckets; a shift, so that differences stay short."""
        return slot << np.uint64(48 - (self.slots - 1).bit_length())


def block_ngrams(block: B.Block, slots: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [(text + row, slot) for row, data, offsets in block.slices() for text, slot in [ngrams(data, offsets, slots)]]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def counted_blocks(docs: DataFrame, labels: DataFrame, p: ResamplingParams) -> tuple[DataFrame, DataFrame, int, Model]:
    """(blocks, blocks with the counts of their slots in both models, buckets, the models' sizes)."""
    spark = docs.sparkSession
    picked = labelled_ids(labels, "quality", p.max_labelled_rows, p.seed).where((F.col("label") == 1) & (F.col("fold") != CALIBRATION)).select(F.col("doc_id").cast("long")).toPandas()["doc_id"]
    good = spark.sparkContext.broadcast(np.sort(picked.to_numpy(np.int64)))
    packed = B.pack(docs, whole_rows=True, level=9)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in B.opened(batches, 0):
            own = np.zeros(len(block.ids), np.int64)
            for row, data, offsets in block.slices():
                first = K.runs(K.NONSPACE[data], offsets)[2]
                words = np.bincount(K.owners(first), minlength=len(offsets) - 1)
                own[row : row + len(words)] = np.maximum(2 * words - 1, 0)
            yield pa.record_batch([pa.array([own.sum()]), pa.array([own[np.isin(block.ids, good.value)].sum()])], ["raw", "target"])

    total = packed.mapInArrow(sizes, "raw long, target long").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    raw, target = total["raw"] or 0, total["target"] or 0
    model = Model(max(1 << p.bits, -(-raw // p.slot_grams)), raw, target)
    buckets = 2 * B.bucket_count(B.total_bytes(packed))  # half of the keys' range may be empty
    if not target:
        return packed, packed, buckets, model

    def slot_counts(block: B.Block, _: list) -> tuple[np.ndarray, ...]:
        text, slot = block_ngrams(block, model.slots)
        kept, at, counts = np.unique(slot, return_inverse=True, return_counts=True)
        own = np.bincount(at[np.isin(block.ids, good.value)[text]], minlength=len(kept))
        return model.place(kept), counts.astype(np.uint64), own.astype(np.uint64)

    def slot_ratios(key: np.ndarray, raw: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
        return (model.ratios(*(B.totals(key, c).astype(float) for c in (raw, target)), p.smooth),)

    counted = B.ask(packed, 0, buckets, slot_counts, slot_ratios, once=True)
    return packed, counted, buckets, model


def weighted(docs: DataFrame, labels: DataFrame, p: ResamplingParams) -> DataFrame:
    """``docs`` with log_weight, mean_ratio and key."""
    packed, counted, buckets, model = counted_blocks(docs, labels, p)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, got in B.opened(batches, 1 if model.target else 0):
            n = len(block.ids)
            total = mean = np.zeros(n)
            if model.target:
                text, slot = block_ngrams(block, model.slots)
                kept, at = np.unique(slot, return_inverse=True)
                ratio = B.bytes_of(model.place(kept), got[0], buckets) / STEPS
                total = np.bincount(text, weights=ratio[at], minlength=n)
                mean = total / np.maximum(1, np.bincount(text, minlength=n))
            yield pa.record_batch([pa.array([block.number]), pa.array([total.tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())], ["block", "log_weight", "mean_ratio"])

    # Scores are made once, so the answers are read once.
    scores = cut(counted.mapInArrow(score, "block long, log_weight binary, mean_ratio binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("log_weight", "mean_ratio")]
            for (block, _), *made in zip(B.opened(iter([batch]), 0), *own, strict=True):
                rows = block.rows(np.ones(len(block.ids), bool))
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(np.frombuffer(x)) for x in made)], names=[*rows.schema.names, "log_weight", "mean_ratio"])

    out = packed.join(scores.hint("merge"), "block").mapInArrow(run, f"{B.fields_of(docs)}, log_weight double, mean_ratio double")
    # The Gumbel noise of a row: from 52 bits of a hash.
    uniform = (F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(p.seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return out.withColumn("key", F.col("mean_ratio") / p.temperature - F.log(-F.log(uniform)))


def ordered_bits(key: str):
    """A long that orders as the double does, from 0 up in its high 62 bits; keys are far within the bounds."""
    scaled = F.least(F.greatest(F.col(key), F.lit(-1e6)), F.lit(1e6))
    return F.floor((scaled + 1e6) * F.lit(float(1 << 42))).cast("long")


def kth_greatest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th greatest value of a long column of 0 to 2**63, by counting 16 bits at a time."""
    if k <= 0:
        return None
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        part = keys if shift == 48 else keys.where(F.shiftright(column, shift + 16) == prefix)
        counts = part.groupBy(F.shiftright(column, shift).alias("p")).count().collect()
        for row in sorted(counts, key=lambda r: -r["p"]):
            if row["count"] >= left:
                prefix = row["p"]
                break
            left -= row["count"]
        else:
            return None
    return prefix


def best_floor(good: np.ndarray, bad: np.ndarray, good_cost: float) -> float | None:
    """The value at which keeping what is not below it costs least: ``good_cost`` for a share of the good lost, 1 for a share of the bad kept; in the middle of the gap there."""
    if not len(good) or not len(bad):
        return None
    values = np.unique(np.concatenate([good, bad]))
    edges = np.concatenate([[values[0]], (values[1:] + values[:-1]) / 2])
    lost = np.searchsorted(np.sort(good), edges) / len(good)
    kept = 1 - np.searchsorted(np.sort(bad), edges) / len(bad)
    return float(edges[np.argmin(good_cost * lost + kept)])


def calibrated_floor(keys: DataFrame, labels: DataFrame, p: ResamplingParams) -> float | None:
    """The floor by the calibration fold's labels: one value an id (the least of its rows), at most ``max_labelled_rows`` of them."""
    picked = labelled_ids(labels, "quality", p.max_labelled_rows, p.seed).where(F.col("fold") == CALIBRATION).select("doc_id", "label")
    seen = keys.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("mean_ratio").alias("x")).select("label", "x").toPandas()
    return best_floor(*(seen.loc[seen["label"] == y, "x"].to_numpy(float) for y in (1, 0)), p.good_cost)


ADDED = ("log_weight", "mean_ratio", "key", "order_bits", "selected")


def resample(docs: DataFrame, labels: DataFrame, p: ResamplingParams = ResamplingParams()) -> DataFrame:
    """``docs`` with log_weight, mean_ratio and selected."""
    if clash := {"block", *ADDED} & set(docs.columns):
        raise ValueError(f"the table already has columns {sorted(clash)}")
    out = weighted(docs, labels, p).withColumn("order_bits", ordered_bits("key"))
    keys = cut(out.select("doc_id", "order_bits", "mean_ratio"))
    k = p.k
    if k is None:
        floor = calibrated_floor(keys, labels, p)
        k = (keys if floor is None else keys.where(F.col("mean_ratio") >= floor)).count()
    edge = kth_greatest(keys, "order_bits", k)
    selected = F.lit(k > 0) if edge is None else F.col("order_bits") >= edge
    return out.withColumn("selected", selected).drop("order_bits", "key")


def quality_sample(docs: DataFrame, labels: DataFrame, p: ResamplingParams = ResamplingParams()) -> DataFrame:
    """Per document: doc_id, log_weight, mean_ratio, selected, kept (the same)."""
    out = resample(docs.select("doc_id", "text"), labels, p)
    return out.select("doc_id", "log_weight", "mean_ratio", "selected", F.col("selected").alias("kept"))
