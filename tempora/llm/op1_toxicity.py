"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are maximal runs of letters, digits and non-ASCII characters, with A-Z lowered. A text's
features are the distinct hashes of its words, its pairs of neighbours and its pairs with one word
between, in ``2**bits`` slots. FTRL-proximal keeps a learning rate for each coordinate, and its L1
term leaves most weights at exactly zero, so the model is a short list of (slot, weight) pairs
whose size is bounded by the hash space, small enough to broadcast whatever the corpus.

Edge cases. A null or empty text has no feature and gets the intercept's score. Repeated rows are
scored alike, each on its own row; an empty table gives an empty result, and with no usable label
every score is 0.5 of an untrained model. Very long texts are read whole. Columns other than the id
and the text are never inputs; the result carries the id and what is computed, so clashing names of
extra columns cannot matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkern as K
from .training import HELD_OUT, fold, labelled_sample


@dataclass(frozen=True)
class ToxicityParams:
    bits: int = 20
    #: The bound of the sample of labelled rows that the model is fitted on.
    max_train_rows: int = 12_000
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    threshold: float = 0.3
    seed: int = 11


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every unigram, bigram and skip-gram of a slice; repeats are left in."""
    starts, ends, first = K.runs(K.ALNUM[data], offsets)
    word = K.RangeHash(data, K.LOWER_VALUES)(starts, ends)
    text = K.owners(first)
    slots, texts = [word >> np.uint64(64 - bits)], [text]
    for gap, salt in ((1, 0x632BE59BD9B4E019), (2, 0xD6E8FEB86659FD93)):
        same = text[gap:] == text[:-gap] if len(text) > gap else np.zeros(0, bool)
        left, right = word[: len(same)][same], word[gap:][same]
        slots.append(K.mix(left * np.uint64(salt) + right) >> np.uint64(64 - bits))
        texts.append(text[gap:][same])
    return np.concatenate(texts), np.concatenate(slots).astype(np.int64)


def fit_ftrl(rows: list[tuple[int, np.ndarray]], p: ToxicityParams) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, slots, weights) after ``epochs`` passes in the given order."""
    size = 1 << p.bits
    z, n = np.zeros(size), np.zeros(size)
    rate = sum(y for y, _ in rows) / max(1, len(rows))
    bias = float(np.log((rate + 1e-3) / (1 - rate + 1e-3))) if rows else 0.0
    squares = 1.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for y, at in rows:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = 1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha
            z[at] = zi + g - step * w
            n[at] = ni + g * g
            squares += g * g
            bias -= 0.05 * g / np.sqrt(squares)
    w = weights(z, n)
    slots = np.flatnonzero(w)
    return bias, slots, w[slots]


def train(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> tuple[float, np.ndarray, np.ndarray]:
    """The model. Features of the bounded sample are made where the texts are; one task then sees the
    sample's feature lists, in the order of a hash, since FTRL is a sequential rule."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, label = batch.column(0), batch.column(1)
            for a, b, data, offsets in K.slices(K.text_column(batch, "text")):
                text, slot = features(data, offsets, p.bits)
                pairs = np.unique((text << p.bits) | slot)
                cut = np.searchsorted(pairs >> p.bits, np.arange(b - a + 1))
                slot = (pairs & ((1 << p.bits) - 1)).astype(np.int32)
                blobs = [slot[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.record_batch([order.slice(a, b - a), label.slice(a, b - a), pa.array(blobs, pa.binary())], ["order", "label", "slots"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, np.frombuffer(s, np.int32)) for batch in batches for y, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        bias, slots, w = fit_ftrl(rows, p)
        yield pa.record_batch([pa.array([bias]), pa.array([slots.astype(np.int32).tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], ["bias", "slots", "weights"])

    sample = labelled_sample(docs, labels, "toxic", p.max_train_rows, p.seed).select("order", "label", "text")
    lists = sample.mapInArrow(featurise, "order long, label int, slots binary")
    model = lists.repartition(1).sortWithinPartitions("order", "slots").mapInArrow(fit, "bias double, slots binary, weights binary").first()
    if model is None:
        return 0.0, np.zeros(0, np.int32), np.zeros(0)
    return model["bias"], np.frombuffer(model["slots"], np.int32), np.frombuffer(model["weights"], np.float64)


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """``docs``' ids with the probability that the text is toxic; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, slots, w = shared.value
        table = np.zeros(1 << p.bits)
        table[slots] = w
        hit = table != 0
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in K.slices(K.text_column(batch, "text")):
                text, slot = features(data, offsets, p.bits)
                found = hit[slot]
                pairs = np.unique((text[found] << p.bits) | slot[found])
                total = bias + np.bincount(pairs >> p.bits, weights=table[pairs & ((1 << p.bits) - 1)], minlength=b - a)
                yield pa.record_batch([ids.slice(a, b - a), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, p), p)
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))
