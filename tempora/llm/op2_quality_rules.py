"""Quality rules: fixed base rules, then a hashed word and character n-gram logistic regression.

Base figures come from the bytes: words are runs of anything but space and \\t-\\r. The model's
inputs are how often each hashed feature occurs among a text's features: words and pairs of words,
and windows of four bytes, in one table of ``2**bits`` weights. Frequencies keep the score of a text
a plain mean of weights, so scoring gathers and sums, whatever the length. The model is fitted on one
part of a bounded sample of labelled rows and calibrated (Platt) on another; labels of the held-out
fold are never read. A document is kept when its base rules hold and its probability of good quality
reaches a fixed threshold.

Edge cases. A null or empty text has no word, all figures 0, and fails the base rules. Repeated rows
are judged alike; an empty table gives an empty result. With labels of one class or none the model
says nothing and the base rules decide alone. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkern as K
from .training import CALIBRATION, labelled_sample

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class QualityParams:
    bits: int = 18
    max_train_rows: int = 6_000
    steps: int = 60
    rate: float = 0.3
    l2: float = 1e-6
    scale: float = 30.0
    min_words: int = 50
    max_repeat_percent: int = 50
    threshold: float = 0.5
    seed: int = 12


class Words:
    """The words of a slice with their hashes; made once for the rules and the model."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.hasher = K.RangeHash(data)
        self.starts, self.ends, self.first = K.runs(K.NONSPACE[data], offsets)
        self.hash = self.hasher(self.starts, self.ends)
        self.text = K.owners(self.first)


def base_figures(w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, offsets, n = w.data, w.offsets, len(w.offsets) - 1
    out = {
        "n_words": np.diff(w.first),
        "word_chars": K.per_text(K.NONSPACE[data] & K.LEAD[data], offsets),
        "n_symbols": K.per_text(_SYMBOL[data], offsets),
    }
    starts, ends, first = K.runs(data != 0x0A, offsets)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(K.NONSPACE[data], out=solid[1:])
    worded = solid[ends] > solid[starts]
    line_text = K.owners(first)[worded]
    lines = w.hasher(starts[worded], ends[worded]) ^ K.mix(line_text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(lines)
    again = lines[order][1:] == lines[order][:-1]
    out["n_dup_lines"] = np.bincount(line_text[order[1:]][again], minlength=n)
    h, t = w.hash, w.text
    repeated = np.zeros(len(h), bool)
    if len(h) >= 3:
        inside = np.flatnonzero(t[2:] == t[:-2])
        grams = K.mix(K.mix(h[inside] * np.uint64(3) + h[inside + 1]) + h[inside + 2]) ^ K.mix(t[inside].astype(np.uint64) + np.uint64(1))
        order = np.argsort(grams)
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(grams), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = inside[twice]
        for step in range(3):
            repeated[at + step] = True
    sums = np.zeros(len(h) + 1, np.int64)
    np.cumsum(repeated, out=sums[1:])
    out["n_repeat_words"] = sums[w.first[1:]] - sums[w.first[:-1]]
    return out


def model_features(w: Words, bits: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """(text, slot) of the word features, and of the character features."""
    shift = np.uint64(64 - bits)
    pair = np.flatnonzero(w.text[1:] == w.text[:-1])
    words = np.concatenate([w.hash, K.mix(w.hash[pair] * np.uint64(0x632BE59BD9B4E019) + w.hash[pair + 1])]) >> shift
    of = np.concatenate([w.text, w.text[pair]])
    d = w.data
    if len(d) < 4:
        chars = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    else:
        v = d[:-3].astype(np.uint32)
        for k in (1, 2, 3):
            v |= d[k : len(d) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
        slot = (v * np.uint32(2654435761) + np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
        text = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
        whole = text[3:] == text[:-3]
        chars = (text[:-3][whole], slot[whole].astype(np.int64))
    return (of, words.astype(np.int64)), chars


def linear_scores(w: Words, weights: np.ndarray, bias: float, p: QualityParams) -> np.ndarray:
    n = len(w.offsets) - 1
    total = np.full(n, bias)
    for text, slot in model_features(w, p.bits):
        count = np.bincount(text, minlength=n)
        total += p.scale * np.bincount(text, weights=weights[slot], minlength=n) / np.maximum(1, count)
    return total


def fit_logistic(rows: list[tuple[int, np.ndarray, np.ndarray]], p: QualityParams) -> tuple[float, np.ndarray]:
    """(bias, weights) by full-batch Adam over sparse rows of (label, slots, values)."""
    size = 1 << p.bits
    w, bias = np.zeros(size, np.float32), 0.0
    y = np.array([r[0] for r in rows], np.float32)
    if len(rows) == 0 or y.min() == y.max():
        return 0.0, w
    used, at = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    value = np.concatenate([r[2] for r in rows])
    lengths = np.array([len(r[1]) for r in rows])
    row = np.repeat(np.arange(len(rows)), lengths)
    u = np.zeros(len(used))
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for step in range(1, p.steps + 1):
        score = np.bincount(row, weights=u[at] * value, minlength=len(rows)) + bias
        err = balance * (1 / (1 + np.exp(-np.clip(score, -35, 35))) - y) / len(rows)
        g = np.bincount(at, weights=value * err[row], minlength=len(used)) + p.l2 * u
        gb = err.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.999**step
        u -= p.rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= p.rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    w[used] = u
    return float(bias), w


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the calibrated log-odds, by Newton steps on Platt's smoothed targets."""
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    spread = max(float(np.abs(score).max()), 1e-9)
    x = np.column_stack([score / spread, np.ones(len(score))])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.clip(np.linalg.solve(h, x.T @ (q - target)), -4, 4)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / spread), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> tuple[float, float, float, np.ndarray]:
    """(slope, intercept, bias, weights)."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.slices(K.text_column(batch, "text")):
                slots, values = [], []
                families = []
                w = Words(data, offsets)
                for text, slot in model_features(w, p.bits):
                    pairs, count = np.unique((text << p.bits) | slot, return_counts=True)
                    total = np.bincount(text, minlength=b - a)
                    families.append((pairs, (p.scale * count / total[pairs >> p.bits]).astype(np.float32)))
                pairs, value = (np.concatenate(x) for x in zip(*families, strict=True))
                order = np.argsort(pairs, kind="stable")
                pairs, value = pairs[order], value[order]
                cut = np.searchsorted(pairs >> p.bits, np.arange(b - a + 1))
                slot = (pairs & ((1 << p.bits) - 1)).astype(np.int32)
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    slots.append(slot[i:j].tobytes())
                    values.append(value[i:j].tobytes())
                yield pa.record_batch(
                    [*(batch.column(k).slice(a, b - a) for k in range(3)), pa.array(slots, pa.binary()), pa.array(values, pa.binary())],
                    ["order", "fold", "label", "slots", "values"],
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["fold"], r["label"], np.frombuffer(r["slots"], np.int32), np.frombuffer(r["values"], np.float32)) for batch in batches for r in batch.to_pylist()]
        bias, w = fit_logistic([r[1:] for r in rows if r[0] != CALIBRATION], p)
        own = [r for r in rows if r[0] == CALIBRATION]
        slope, intercept = platt(np.array([bias + float(w[s] @ v) for _, _, s, v in own]), np.array([r[1] for r in own])) if w.any() else (0.0, 35.0)
        slots = np.flatnonzero(w)
        yield pa.record_batch(
            [pa.array([slope]), pa.array([intercept]), pa.array([bias]), pa.array([slots.astype(np.int32).tobytes()], pa.binary()), pa.array([w[slots].tobytes()], pa.binary())],
            ["slope", "intercept", "bias", "slots", "weights"],
        )

    sample = labelled_sample(docs, labels, "quality", p.max_train_rows, p.seed)
    lists = sample.mapInArrow(featurise, "order long, fold int, label int, slots binary, values binary")
    got = lists.repartition(1).sortWithinPartitions("order", "slots").mapInArrow(fit, "slope double, intercept double, bias double, slots binary, weights binary").first()
    w = np.zeros(1 << p.bits, np.float32)
    if got is None:
        return 0.0, 35.0, 0.0, w
    w[np.frombuffer(got["slots"], np.int32)] = np.frombuffer(got["weights"], np.float32)
    return got["slope"], got["intercept"], got["bias"], w


def quality_rules(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """Per document: doc_id, the base figures, base_failed, kept, probability. One pass, no shuffle of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, p))
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, intercept, bias, weights = shared.value
        for batch in batches:
            for a, b, data, offsets in K.slices(K.text_column(batch, "text")):
                w = Words(data, offsets)
                base = base_figures(w)
                failed = (base["n_words"] < p.min_words) | (100 * base["n_repeat_words"] > p.max_repeat_percent * base["n_words"])
                prob = 1 / (1 + np.exp(-np.clip(slope * linear_scores(w, weights, bias, p) + intercept, -35, 35)))
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), *(pa.array(base[k].astype(np.int64)) for k in figures), pa.array(failed), pa.array(~failed & (prob >= p.threshold)), pa.array(prob)],
                    ["doc_id", *figures, "base_failed", "kept", "probability"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{k} long' for k in figures)}, base_failed boolean, kept boolean, probability double")
