"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, distributed union-find; one line of each component stays.

Lines are the \\n-separated parts of all texts; a line without a word is never a duplicate. Equal lines are first one line, kept
at its first place (least doc_id, then first in the text): blocks report a line's hash once, so a line of a third of all
documents reaches its bucket once per block. Of different lines, each has the set of its hashed ``SHINGLE``-character shingles (a shorter line is one
shingle) and one permutation hashing of ``BANDS * ROWS`` bins, an empty bin filled from a bin drawn for it. A band's key that only one
line has proposes nothing and never leaves the block; the others become candidates. At Jaccard 0.75 a pair shares none of 16 bands of 4
rows with a chance of 0.002. Candidates travel as their texts, are compared exactly and joined into components without making all pairs of
a group (see ``pairs``). Of each component the line with the first place stays, in all other places lines of it go.

Lines are found once, where blocks are packed; a block's line index travels with it.

Edge cases. A null text is read as an empty one, which has no line with a word. Very long lines are read whole. Equal rows: the
copy that comes first keeps its lines (rows that share an id: one of them). A missing id comes before all; an id that is not a whole number raises. Empty tables give empty results. Other columns travel along in
``dedup_lines``, but n_chars, where there is one, is set anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textkern as K
from .pairs import near_components
from .workdir import Scratch, cut

SHINGLE = 8
BANDS, ROWS = 16, 4
PERCENT = 75
#: For each bin, the order in which it looks for a full one.
FILL_ORDER = np.argsort(np.random.Generator(np.random.Philox(8)).random((BANDS * ROWS, BANDS * ROWS)), axis=1)


def line_index(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, length, number in the text, hash) of the lines with a word of a slice."""
    at = np.flatnonzero(data == 0x0A)
    starts, ends = np.sort(np.concatenate([offsets[:-1], at + 1])), np.sort(np.concatenate([at, offsets[1:]]))
    some = ends > starts
    starts, ends = starts[some], ends[some]
    worded = K.NONSPACE[data[starts]]
    for i in np.flatnonzero(~worded):
        worded[i] = K.NONSPACE[data[starts[i] : ends[i]]].any()
    starts, ends = starts[worded], ends[worded]
    text = np.searchsorted(offsets, starts, "right") - 1
    number = np.searchsorted(at, starts) - np.searchsorted(at, offsets)[text]
    return text, starts, ends - starts, number, K.hashes_in_order(data, starts, ends)


class Lines:
    """The lines with a word of a block, as its index has them: text, number in the text, hash; the first of each hash by (id, number)."""

    def __init__(self, block: B.Block):
        self.block = block
        start, text, length, number, self.hash = block.index()
        self.start, self.text, self.number = start.astype(np.int64), text.astype(np.int64), number.astype(np.int64)
        self.end = self.start + length.astype(np.int64)
        self.rank = B.id_rank(block.ids)[self.text]
        self.order = np.lexsort((self.text, self.number, self.rank, self.hash))
        self.groups = B.group_starts(self.hash[self.order])

    def firsts(self) -> np.ndarray:
        """The first line of each hash, in order of hash."""
        return self.order[self.groups]

    def columns(self) -> tuple[np.ndarray, ...]:
        at = self.firsts()
        return self.hash[at] >> np.uint64(16), self.hash[at] & np.uint64(0xFFFF), self.rank[at], np.full(len(at), self.block.number, np.uint64)


def first_answer(key: np.ndarray, low: np.ndarray, rank: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each line: does another block have it first (by id, then block)."""
    order = np.lexsort((block, rank, low, key))
    groups = B.group_starts(key[order], low[order])
    later = np.ones(len(key), bool)
    later[order[groups]] = False
    return (later,)


def line_shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of each ``SHINGLE``-character shingle of lines of a slice, in order of start; a shorter line is one shingle, and comes last.

    A shingle's hash is a polynomial of its code points, made for all places of the slice by doubling."""
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    code += np.uint64(1)
    code *= np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(32)
    # A character's place is its byte's, less the later bytes of characters before it.
    later = np.flatnonzero((data & 0xC0) == 0x80)
    first, last = starts - np.searchsorted(later, starts), ends - np.searchsorted(later, ends) - SHINGLE
    rolled, width, factor = code, 1, 0xD1342543DE82EF95
    while width < SHINGLE:
        longer = rolled[:-width] * np.uint64(factor)
        longer += rolled[width:][: len(longer)]
        rolled, width, factor = longer, 2 * width, factor * factor % (1 << 64)
    whole = np.flatnonzero(last >= first)
    made = last[whole] - first[whole] + 1
    short = np.flatnonzero(last < first)
    chars = last[short] + SHINGLE - first[short]
    value = chars.astype(np.uint64)
    for step in range(SHINGLE - 1):
        more = chars > step
        value[more] = K.mix(value[more] + code[first[short[more]] + step])
    h = np.concatenate([rolled[:0], *(rolled[a : a + n] for a, n in zip(first[whole].tolist(), made.tolist(), strict=True))])
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.concatenate([np.repeat(whole, made), short]), np.concatenate([h, value])


def band_keys(line: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """(n, BANDS) keys: one permutation hashing; an empty bin takes the value of the first full bin in a random order of its own.

    So one shingle of a short line fills bins here and there, not a run of neighbours that touches every band.
    """
    bins = BANDS * ROWS
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * bins, empty)
    np.minimum.at(sig, line * bins + (shingle & np.uint64(bins - 1)).astype(np.int64), shingle >> np.uint64(8))
    sig = sig.reshape(n, bins)
    full = sig != empty
    row, place = np.nonzero(~full & full.any(axis=1)[:, None])
    for step in range(bins):
        if not len(row):
            break
        source = FILL_ORDER[place, step]
        found = full[row, source]
        sig[row[found], place[found]] = sig[row[found], source[found]]
        row, place = row[~found], place[~found]
    key = np.zeros((n, BANDS), np.uint64)
    for r in range(ROWS):
        key = K.mix(key + sig[:, r * BANDS : (r + 1) * BANDS])
    return K.mix(key + np.arange(BANDS, dtype=np.uint64))


def line_sets(lines: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of some lines."""
    ends = np.cumsum([len(x) for x in lines])
    line, shingle = line_shingles(np.frombuffer(b"".join(lines), np.uint8), ends - [len(x) for x in lines], ends)
    order = K.order_within(line, shingle)
    line, shingle = line[order], shingle[order]
    keep = B.group_starts(line, shingle)
    line, shingle = line[keep], shingle[keep]
    return np.split(shingle, np.searchsorted(line, np.arange(1, len(lines))))


def set_sizes(line: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """How many different shingles each of n lines has: all of them, but for lines with two that begin with the same bits, which are counted whole."""
    size = np.bincount(line, minlength=n)
    bits = max(1, (n - 1).bit_length())
    seen = np.sort(line.astype(np.uint64) << np.uint64(64 - bits) | shingle >> np.uint64(bits))
    again = np.zeros(n, bool)
    again[(seen[1:][seen[1:] == seen[:-1]] >> np.uint64(64 - bits)).astype(np.int64)] = True
    part = again[line]
    line, shingle = line[part], shingle[part]
    order = K.order_within(line, shingle)
    size[again] = np.bincount(line[order][B.group_starts(line[order], shingle[order])], minlength=n)[again]
    return size


def owned_bands(lines: Lines, own: np.ndarray) -> np.ndarray:
    """The 48-bit band keys of some lines of a block."""
    out = np.zeros((len(own), BANDS), np.uint64)
    for pick, data, starts, ends in owned_slices(lines, own):
        line, shingle = line_shingles(data, starts, ends)
        out[pick] = band_keys(line, shingle, len(pick)) >> np.uint64(16)
    return out


def owned_slices(lines: Lines, own: np.ndarray) -> Iterator[tuple]:
    """(which of ``own``, bytes, starts, ends) of stretches of the block, small enough for a processor's cache but for one longer line; bytes are those of the
    lines alone where they are a small part."""
    by_start = np.argsort(lines.start[own])
    begin, end = lines.start[own[by_start]], lines.end[own[by_start]]
    for a, b in K.stretches(begin, end):
        base, pick = begin[a], by_start[a:b]
        data, starts, ends = lines.block.data[base : end[b - 1]], begin[a:b] - base, end[a:b] - base
        if 2 * (ends - starts).sum() < len(data):
            data = np.concatenate([data[x:y] for x, y in zip(starts, ends, strict=True)])
            starts, ends = np.cumsum(ends - starts) - (ends - starts), np.cumsum(ends - starts)
        yield pick, data, starts, ends


class BandRow:
    """The band keys of the lines that a block owns."""

    def __init__(self, number: int, own: bytes, keys: bytes):
        self.number, self.own, self.keys = number, np.frombuffer(own, np.int32), B.decode_keys(keys, BANDS)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct keys, and in how many lines each is; a line has no key twice, as a key knows its band."""
        keys = np.sort(self.keys, axis=None)
        starts = B.group_starts(keys)
        return keys[starts], np.diff(np.append(starts, len(keys))).astype(np.uint64)

    def spread(self, answered: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """What is answered for the sorted distinct keys, at each key's places."""
        flat = self.keys.ravel()
        order = np.argsort(flat)
        starts = B.group_starts(flat[order])
        out = np.zeros(len(flat), np.int64)
        out[order] = np.repeat(answered(flat[order[starts]]), np.diff(np.append(starts, len(flat))))
        return out.reshape(self.keys.shape)

    @classmethod
    def opened(cls, batches: Iterator[pa.RecordBatch], answers: int) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                yield cls(r["block"], r["own"], r["keys"]), [{x["bucket"]: x["bits"] for x in r[f"answer{k}"] or ()} for k in range(answers)]


def judged_lines(docs: DataFrame, whole_rows: bool = False):
    """(blocks with the answers and the near-duplicate lines, a function that gives a block's lines and which of them go)."""
    packed = B.pack(docs, whole_rows=whole_rows, index=line_index)
    buckets = B.bucket_count(B.total_bytes(packed), 1 / 20)

    def line_keys(block: B.Block, _: list) -> tuple[np.ndarray, ...]:
        return Lines(block).columns()

    def owners_of(block: B.Block, got: list) -> tuple[Lines, np.ndarray, np.ndarray]:
        """The lines, those first of their hash in all documents, and which hashes of the block another has first."""
        lines = Lines(block)
        at = lines.firsts()
        (later,) = B.bits_of(lines.hash[at] >> np.uint64(16), got[0], buckets, 1)
        return lines, at[~later], later

    asked = B.ask(packed, 0, buckets, line_keys, first_answer)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, got in B.opened(batches, 1):
            lines, own, _ = owners_of(block, got)
            yield pa.record_batch([pa.array([block.number]), pa.array([own.astype(np.int32).tobytes()], pa.binary()), pa.array([B.encode_keys(owned_bands(lines, own))], pa.binary())], ["block", "own", "keys"])

    # Signatures are made once; what is kept of them are the band keys.
    bands = B.ask(cut(asked.mapInArrow(compute, "block long, own binary, keys binary")), 0, buckets, lambda row, _: row.counts(), B.class_answer, opener=BandRow.opened)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, got in BandRow.opened(batches, 1):
            own = row.spread(lambda sent: sum(c.astype(np.int64) << k for k, c in enumerate(B.bits_of(sent, got[0], buckets, B.CLASS_BITS))))  # noqa: B023
            chosen = (own > 0).any(axis=1)
            some = own[chosen] > 0
            yield pa.record_batch(
                [pa.array([row.number]), pa.array([row.own[chosen].tobytes()], pa.binary()), pa.array([B.encode_keys(row.keys[chosen])], pa.binary()), pa.array([np.packbits(some).tobytes()], pa.binary()), pa.array([own[chosen].sum(axis=1).astype(np.int16).tobytes()], pa.binary())],
                ["block", "own", "keys", "some", "often"],
            )

    chosen_lines = cut(bands.mapInArrow(choose, "block long, own binary, keys binary, some binary, often binary"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("own", "keys", "some", "often")]
            for (block, _), own, keys, some, often in zip(B.opened(iter([batch]), 0), *parts, strict=True):
                own = np.frombuffer(own, np.int32).astype(np.int64)
                if not len(own):
                    continue
                lines, keys = Lines(block), B.decode_keys(keys, BANDS)
                some = np.unpackbits(np.frombuffer(some, np.uint8))[: keys.size].reshape(keys.shape).astype(bool)
                odd = BANDS * ((1 << B.CLASS_BITS) - 1) - np.frombuffer(often, np.int16)
                for pick, data, starts, ends in owned_slices(lines, own):
                    line, shingle = line_shingles(data, starts, ends)
                    at, has = own[pick], some[pick]
                    yield pa.record_batch(
                        [
                            pa.array(lines.hash[at].view(np.int64)),
                            pa.array(set_sizes(line, shingle, len(pick))),
                            pa.array([data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                            pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has.sum(axis=1))), pa.int32()), pa.array(keys[pick][has].view(np.int64))),
                            pa.array(odd[pick].astype(np.int32)),
                            pa.array((lines.rank[at] ^ np.uint64(1 << 63)).view(np.int64)),
                            pa.array(lines.number[at]),
                            pa.array([block.number] * len(pick), pa.int64()),
                        ],
                        ["node", "n", "members", "keys", "odd", "doc", "number", "block"],
                    )

    scratch = Scratch(docs.sparkSession)
    with_lines = packed.join(chosen_lines.hint("merge"), "block")
    found = scratch.keep(with_lines.mapInArrow(candidates, "node long, n long, members binary, keys array<long>, odd int, doc long, number long, block long"))
    comps = near_components(found, lambda _: found.select("node", "n", "members"), PERCENT, scratch, line_sets, shared_keys=True)
    placed = comps.join(found.select("node", F.struct("doc", "number", "node").alias("place")), "node")
    stays = placed.groupBy("comp").agg(F.min("place").alias("first"))
    gone = placed.join(stays, "comp").where(F.col("place") != F.col("first")).select("node")
    # Only the block where a line has its first place still has it; each block gets its own, as many as it has lines at most.
    each = cut(gone.join(found.select("node", "block"), "node").groupBy("block").agg(F.collect_list("node").alias("near")))
    scratch.close()
    full = asked.join(each.hint("merge"), "block", "left")

    def judge(block: B.Block, got: list, near: list | None) -> tuple[Lines, np.ndarray]:
        lines, _, later = owners_of(block, got)
        goes = np.ones(len(lines.order), bool)
        at = lines.firsts()
        goes[at] = later | np.isin(lines.hash[at], np.array(near or [], np.int64).view(np.uint64))
        return lines, goes

    return full, judge


def each_judged(batches: Iterator[pa.RecordBatch], judge) -> Iterator[tuple[B.Block, Lines, np.ndarray]]:
    for batch in batches:
        near = batch.column(batch.schema.get_field_index("near")).to_pylist()
        for (block, got), own in zip(B.opened(iter([batch]), 1), near, strict=True):
            yield block, *judge(block, got, own)


def without(block: B.Block, lines: Lines, goes: np.ndarray) -> pa.Array:
    """The texts without some lines and their line ends."""
    start, end, text = lines.start[goes], lines.end[goes], lines.text[goes]
    end = end + (end < block.offsets[text + 1])
    length = np.diff(block.offsets)
    np.subtract.at(length, text, end - start)
    stays = zip([0, *end.tolist()], [*start.tolist(), len(block.data)], strict=True)
    left = np.concatenate([block.data[:0], *(block.data[a:b] for a, b in stays if a < b)])
    return pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.py_buffer(left)])


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines (with a word), n_removed, text (what is left)."""
    full, judge = judged_lines(docs)
    kind, id_type = docs.schema["doc_id"].dataType, B.id_type(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, lines, goes in each_judged(batches, judge):
            n = len(block.ids)
            yield pa.record_batch(
                [block.id_column(id_type), pa.array(np.bincount(lines.text, minlength=n)), pa.array(np.bincount(lines.text[goes], minlength=n)), without(block, lines, goes)],
                ["doc_id", "n_lines", "n_removed", "text"],
            )

    return full.mapInArrow(run, f"doc_id {kind.simpleString()}, n_lines long, n_removed long, text string")


def line_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, text_sha256 (of what is left)."""
    return line_report(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def dedup_lines(docs: DataFrame, drop_emptied: bool = True) -> DataFrame:
    """``docs`` with what is left of their texts and n_chars set anew; documents that lose all their lines go, unless told otherwise."""
    full, judge = judged_lines(docs, whole_rows=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, lines, goes in each_judged(batches, judge):
            n = len(block.ids)
            removed = np.bincount(lines.text[goes], minlength=n)
            left = without(block, lines, goes)
            emptied = (removed > 0) & (removed == np.bincount(lines.text, minlength=n))
            yield block.rows(~(emptied & drop_emptied), left)

    out = full.mapInArrow(run, B.fields_of(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
