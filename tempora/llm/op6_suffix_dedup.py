"""Repeated windows of bytes, by a depth-limited most-significant-digit radix sort of suffixes.

Suffixes are ordered through ``width`` bytes only, in two digits, and a group that has become a
single document is left alone at once. To keep the first pass small, only suffixes at sampled
positions enter it: in each window of ``width`` bytes the gram of ``GRAM`` bytes with the least hash
is its anchor (the leftmost among equals), so equal windows have equal anchors at equal places, and
the windows of a text that share an anchor are a range of consecutive starts. Digit one is the hashed
anchor gram: most grams are in one document, and their ranges are done. Digit two is all that the
windows of a range cover: in a group of equal grams and equal covers, every document but the least
has all those windows earlier. Where one gram has several covers, the least document of each cover
announces its single windows, at full depth, and equal ones meet. What is left is exact up to
collisions of 64-bit hashes.

Hot passages do not gather: a block of documents reports a gram, cover or window once, with its least
document, and gets bits back (see ``blocks``). Texts do not move after they are packed.

Edge cases. A null or short text has no window, loses nothing and has its own hash (that of no bytes for a null
or empty one). Exact copies lose all if they have a window. Rows with equal ids are not earlier than each other;
a missing id comes before all. Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B
from . import textkern as K

WIDTH = 50
GRAM = 24


def anchor_ranges(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, gram hash, cover hash) of the ranges of a slice."""
    n = len(data)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if n < width:
        return none
    hasher = K.RangeHash(data)
    grams = hasher.windows(gram)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, step = width - gram + 1, 1
    while step * 2 <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if span > step:
        low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
    valid = np.ones(n - width + 1, bool)
    for end in offsets[1:-1]:
        valid[max(0, end - width + 1) : end] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none
    anchor = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    first, last, at = starts[begin], starts[np.append(begin[1:], len(starts)) - 1], anchor[begin]
    cover = K.mix(hasher(first, last + width) + (at - first).astype(np.uint64))
    return np.searchsorted(offsets, first, "right") - 1, first, last, grams[at], cover


class Ranges:
    """The ranges of a block in the order of (gram, cover, id), and its distinct (gram, cover)."""

    def __init__(self, block: B.Block, width: int, gram: int):
        parts = []
        for row, data, offsets in block.slices():
            text, first, last, key, cover = anchor_ranges(data, offsets, width, gram)
            parts.append((text + row, first + block.offsets[row], last + block.offsets[row], key >> np.uint64(16), cover))
        text, first, last, key, cover = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        rank = B.id_rank(block.ids)[text]
        order = np.lexsort((rank, cover, key))
        self.text, self.first, self.last, self.key, self.cover, self.rank = (x[order] for x in (text, first, last, key, cover, rank))

    def keep(self, mask: np.ndarray) -> None:
        self.text, self.first, self.last, self.key, self.cover, self.rank = (x[mask] for x in (self.text, self.first, self.last, self.key, self.cover, self.rank))

    def shared(self, answer: dict[int, bytes], buckets: int) -> None:
        """Leave only ranges whose gram is in two documents or more."""
        grams = self.key[B.group_starts(self.key)]
        (bits,) = B.bits_of(grams, answer, buckets, 1)
        self.keep(np.repeat(bits, np.diff(np.append(B.group_starts(self.key), len(self.key)))))

    def covers(self) -> tuple[np.ndarray, np.ndarray]:
        """The first range of each (gram, cover), that of the least id, and how many there are."""
        starts = B.group_starts(self.key, self.cover)
        return starts, np.diff(np.append(starts, len(self.key)))


def _cover_answer(key: np.ndarray, cover: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each (gram, cover): has a smaller id it in another block; must this one announce its windows."""
    order = np.lexsort((cover, key))
    k, c, r = key[order], cover[order], rank[order]
    groups = B.group_starts(k, c)
    sizes = np.diff(np.append(groups, len(k)))
    least = np.repeat(np.minimum.reduceat(r, groups), sizes) if len(k) else r
    per_gram = np.diff(np.append(np.searchsorted(groups, B.group_starts(k)), len(groups)))
    several = np.repeat(np.repeat(per_gram > 1, per_gram), sizes)
    earlier, announce = np.zeros(len(k), bool), np.zeros(len(k), bool)
    earlier[order] = least < r
    announce[order] = several & (least == r)
    return earlier, announce


def _window_answer(key: np.ndarray, low: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each window: has a smaller id it in another block."""
    order = np.lexsort((low, key))
    k, w, r = key[order], low[order], rank[order]
    groups = B.group_starts(k, w)
    least = np.repeat(np.minimum.reduceat(r, groups), np.diff(np.append(groups, len(k)))) if len(k) else r
    earlier = np.zeros(len(k), bool)
    earlier[order] = least < r
    return (earlier,)


def expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, start) of every start in ranges."""
    sizes = last - first + 1
    of = np.repeat(np.arange(len(first)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[of]


def window_hashes(block: B.Block, start: np.ndarray, width: int) -> np.ndarray:
    """The hash of the window at each start."""
    out = np.zeros(len(start), np.uint64)
    for row, data, offsets in block.slices():
        base = block.offsets[row]
        own = np.flatnonzero((start >= base) & (start < base + len(data)))
        if len(own):
            at = start[own] - base
            out[own] = K.RangeHash(data)(at, at + width)
    return out


class Announced:
    """The windows that a block announces: all those of its announcing ranges, by hash."""

    def __init__(self, block: B.Block, ranges: Ranges, announce: np.ndarray, width: int):
        """``announce``: of all ranges, those of the least document of a cover that must announce."""
        self.of = np.flatnonzero(announce)
        of, self.start = expand(ranges.first[self.of], ranges.last[self.of])
        self.rank = ranges.rank[self.of][of]
        self.hash = window_hashes(block, self.start, width)
        self.order = np.lexsort((self.rank, self.hash))
        h = self.hash[self.order]
        self.groups = B.group_starts(h)
        self.keys = h[self.groups]

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.keys >> np.uint64(16), self.keys & np.uint64(0xFFFF), self.rank[self.order][self.groups]

    def repeated(self, earlier: np.ndarray) -> np.ndarray:
        """The starts whose window is in a document of a smaller id, here or (``earlier``) in another block."""
        rank = self.rank[self.order]
        sizes = np.diff(np.append(self.groups, len(rank)))
        here = rank > np.repeat(rank[self.groups], sizes)
        return self.start[self.order][here | np.repeat(earlier, sizes)]


def repeated_starts(docs: DataFrame, width: int = WIDTH, gram: int = GRAM):
    """(blocks with all answers, a function that finds a block's repeated window starts)."""
    packed = B.pack(docs)
    size = B.total_bytes(packed)
    many, few = B.bucket_count(size, 1 / 12), B.bucket_count(size, 1 / 20)

    def gram_keys(block: B.Block, _: list) -> tuple[np.ndarray, ...]:
        r = Ranges(block, width, gram)
        return B.counted(r.key, r.text)

    def cover_keys(block: B.Block, got: list) -> tuple[np.ndarray, ...]:
        r = Ranges(block, width, gram)
        r.shared(got[0], many)
        at, _ = r.covers()
        return r.key[at], r.cover[at], r.rank[at]

    def judged(block: B.Block, got: list) -> tuple[Ranges, np.ndarray, np.ndarray]:
        """The shared ranges; those that are wholly repeated; those that announce."""
        r = Ranges(block, width, gram)
        r.shared(got[0], many)
        at, sizes = r.covers()
        earlier, announce = B.bits_of(r.key[at], got[1], few, 2)
        least = np.repeat(r.rank[at], sizes)
        return r, (r.rank > least) | np.repeat(earlier, sizes), np.repeat(announce, sizes) & (r.rank == least)

    def window_keys(block: B.Block, got: list) -> tuple[np.ndarray, ...]:
        r, _, announce = judged(block, got)
        return Announced(block, r, announce, width).columns()

    def find(block: B.Block, got: list) -> np.ndarray:
        r, whole, announce = judged(block, got)
        windows = Announced(block, r, announce, width)
        (earlier,) = B.bits_of(windows.keys >> np.uint64(16), got[2], few, 1)
        return np.concatenate([expand(r.first[whole], r.last[whole])[1], windows.repeated(earlier)])

    asked = B.ask(packed, 0, many, gram_keys, B.shared_answer)
    asked = B.ask(asked, 1, few, cover_keys, _cover_answer)
    return B.ask(asked, 2, few, window_keys, _window_answer), find


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    asked, find = repeated_starts(docs, width, gram)
    kind, id_type = docs.schema["doc_id"].dataType, B.id_type(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, got in B.opened(batches, 3):
            starts = find(block, got)
            edge = np.zeros(len(block.data) + 1, np.int32)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + width, -1)
            gone = np.cumsum(edge[:-1]) > 0
            _, _, first = K.runs(gone, block.offsets)
            kept = [block.data[a:b][~gone[a:b]].tobytes() for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
            yield pa.record_batch(
                [block.id_column(id_type), pa.array(np.diff(block.offsets)), pa.array(K.per_text(gone, block.offsets)), pa.array(np.diff(first)), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return asked.mapInArrow(run, f"doc_id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def repeats_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    from pyspark.sql import functions as F

    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
