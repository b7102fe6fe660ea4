"""N-gram Jaccard join: documents whose sets of word shingles overlap by the threshold, and their components.

A document's set holds its distinct ``size``-word shingles, hashed to 64 bits, of its words with A-Z lowered.
Candidates come from a prefix in the order (how many documents have a shingle, by doublings; then its hash): two
sets that reach the threshold share a shingle among the first n - ceil(t * n) + 1 of either. The document counts of all
shingles are gathered over all documents (see ``blocks``). A shingle of one document links nothing, and most documents have
so many of them that their prefix holds no other: those are done without leaving their block. Shingles that many
documents share come last, so passages and common phrases link nothing that has enough text of its own.

Documents with equal sets are one node; different sets are compared in size-banded tiles with bitmap bounds before
the exact intersection, and no link between different texts is lost (see ``pairs``).

Edge cases. A null or wordless text has an empty set and is linked with nothing; fewer words than ``size`` are one
shingle. Each row is a document of its own, also where rows share an id or have none: their ids alone link nothing. A missing id is null in the
result and, where others link to it, the least. An id that is not a whole number raises. Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textkern as K
from .pairs import bitmap, near_components
from .workdir import Scratch, cut

SIZE = 5
PERCENT = 75


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, in order of text and hash."""
    starts, ends, first = K.runs(K.NONSPACE[data], offsets)
    word = K.RangeHash(data, K.LOWER_VALUES)(starts, ends)
    text, count = K.owners(first), np.diff(first)
    if not len(word):
        return text, word
    rolled = word.copy()
    made = np.minimum(np.maximum(count - size + 1, np.minimum(count, 1)), count)
    at = np.repeat(first[:-1], made) + np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
    of = text[at]
    length = np.minimum(count, size)[of]
    rolled = word[at]
    for step in range(1, size):
        more = length > step
        rolled[more] = K.mix(rolled[more] * np.uint64(0x632BE59BD9B4E019) + word[at[more] + step])
    rolled = K.mix(rolled + length.astype(np.uint64))
    order = K.order_within(of, rolled)
    of, rolled = of[order], rolled[order]
    keep = B.group_starts(of, rolled)
    return of[keep], rolled[keep]


def block_sets(block: B.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [(text + row, h) for row, data, offsets in block.slices() for text, h in [shingle_sets(data, offsets, size)]]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return text, h


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sorted_keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, distinct sorted keys, how often each) of the 48-bit keys of hashes."""
    key = h >> np.uint64(16)
    order = np.argsort(key)
    starts = B.group_starts(key[order])
    return order, key[order][starts], np.diff(np.append(starts, len(key)))


def prefixed(packed: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """(row, own, n_shingles, same, set_a, set_b, keys, place, block) of each document: its row's number, its id, the first row of its block with
    the same set; where its prefix has shared shingles and no row of the block has the set before it, hashes of the set and the prefix, whose
    first is at ``place`` in the order of its shingles."""
    buckets = B.bucket_count(B.total_bytes(packed))

    def keys(block: B.Block, _: list) -> tuple[np.ndarray, ...]:
        _, sent, often = sorted_keys(block_sets(block, size)[1])
        return sent, often.astype(np.uint64)

    asked = B.ask(packed, 0, buckets, keys, B.class_answer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, got in B.opened(batches, 1):
            text, h = block_sets(block, size)
            order, sent, often = sorted_keys(h)
            bits = B.bits_of(sent, got[0], buckets, B.CLASS_BITS)
            rank = np.zeros(len(h), np.int8)
            rank[order] = np.repeat(sum(c.astype(np.int8) << k for k, c in enumerate(bits)), often)
            first = np.searchsorted(text, np.arange(len(block.ids) + 1))
            n = np.diff(first)
            length = n - (n * percent + 99) // 100 + 1
            alone = np.zeros(len(h) + 1, np.int64)
            np.cumsum(rank == 0, out=alone[1:])
            lone = alone[first[1:]] - alone[first[:-1]]
            prefix, ones, twos, same = [None] * len(n), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.arange(len(n))
            seen: dict[tuple, int] = {}
            for i in np.flatnonzero((n > 0) & (lone < length)):
                own, r = h[first[i] : first[i + 1]], rank[first[i] : first[i + 1]]
                ones[i] = signed(own.sum(dtype=np.uint64, keepdims=True))[0]
                twos[i] = signed(K.mix(own).sum(dtype=np.uint64, keepdims=True))[0]
                same[i] = seen.setdefault((int(ones[i]), int(twos[i]), int(n[i])), int(i))
                if same[i] == i:
                    # Hashes are sorted within a text, so the order by rank alone is stable by hash.
                    chosen = np.argsort(r, kind="stable")[lone[i] : length[i]]
                    prefix[i] = (own[chosen] >> np.uint64(16)).view(np.int64)
            yield pa.record_batch(
                [pa.array(block.number + np.arange(len(n))), pa.array(block.ids), pa.array(n), pa.array(block.number + same), pa.array(ones), pa.array(twos), pa.array(prefix, pa.list_(pa.int64())), pa.array(lone), pa.array([block.number] * len(n), pa.int64())],
                ["row", "own", "n_shingles", "same", "set_a", "set_b", "keys", "place", "block"],
            )

    return scratch.keep(asked.mapInArrow(run, "row long, own long, n_shingles long, same long, set_a long, set_b long, keys array<long>, place long, block long"))


def sets_of(packed: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """(node, n, members, bits) of the documents at some places (block, node: the row's number); texts are read in their blocks."""
    each = cut(places.groupBy("block").agg(F.collect_list("node").alias("some")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (block, _), some in zip(B.opened(iter([batch]), 0), batch.column(batch.schema.get_field_index("some")).to_pylist(), strict=True):
                nth = np.array(some) - block.number
                part = B.Block.of_texts(block, nth)
                text, h = block_sets(part, size)
                first = np.searchsorted(text, np.arange(len(nth) + 1))
                sets = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.record_batch(
                    [pa.array(some, pa.int64()), pa.array(np.diff(first)), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([bitmap(s) for s in sets], pa.list_(pa.int64()))],
                    ["node", "n", "members", "bits"],
                )

    return packed.join(each.hint("merge"), "block").mapInArrow(run, "node long, n long, members binary, bits array<long>")


def linked(packed: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """((row, own, n_shingles, block) of all documents, (row, comp) of those that are linked with others).

    Equal sets are first one row a block, then one row of all, so a set that a third of all documents have is joined once a block."""
    scratch = Scratch(packed.sparkSession)
    base = prefixed(packed, size, percent, scratch)
    equal = ["set_a", "set_b", "n_shingles"]
    candidates = base.where(F.col("keys").isNotNull())
    classes = scratch.keep(candidates.groupBy(*equal).agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("blocks")))
    reps = candidates.join(classes.select("node"), F.col("row") == F.col("node")).select("node", F.col("n_shingles").alias("n"), "keys", "place", "block")
    reps = scratch.keep(reps)
    near = near_components(reps, lambda wanted: sets_of(packed, reps.select("node", "block").join(wanted, "node"), size), percent, scratch, best_first=True)
    # Rows of a block take the class of its first row with their set, classes the component of their set.
    in_class = candidates.join(classes.where("blocks > 1").drop("blocks"), equal).select(F.col("row").alias("same"), "node")
    rows = base.where(F.col("set_a").isNotNull()).select("row", "same").join(in_class, "same", "left").select("row", F.coalesce("node", "same").alias("node"))
    labels = scratch.keep(rows.join(near, "node", "left").select("row", F.coalesce("comp", "node").alias("comp")))
    several = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("comp")
    comps = scratch.keep(labels.join(several, "comp").select("row", "comp"))
    base = base.select("row", "own", "n_shingles", "block")
    scratch.close(base, comps)
    return base, comps


def ngram_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least id reachable by links)."""
    base, comps = linked(B.pack(docs), size, percent)
    with_comp = base.join(comps, "row", "left")
    least = with_comp.where("comp IS NOT NULL").groupBy("comp").agg(F.min("own").alias("least"))
    out = with_comp.join(least, "comp", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = lambda c: F.when(c != B.NO_ID, c).cast(kind)
    return out.select(known(F.col("own")).alias("doc_id"), "n_shingles", known(F.coalesce("least", "own")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: of its least id the first in the table. Rows that nothing is linked with all stay, with or without an id of their own.
    All columns stay; texts leave their block only here."""
    packed = B.pack(docs, whole_rows=True)
    base, comps = linked(packed, size, percent)
    placed = base.join(comps, "row").select("row", "block", "comp", F.struct("own", "row").alias("at"))
    stays = placed.groupBy("comp").agg(F.min("at").alias("first"))
    gone = placed.join(stays, "comp").where(F.col("at") != F.col("first"))
    each = cut(gone.groupBy("block").agg(F.collect_list("row").alias("gone")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (block, _), away in zip(B.opened(iter([batch]), 0), batch.column(batch.schema.get_field_index("gone")).to_pylist(), strict=True):
                keep = np.ones(len(block.ids), bool)
                keep[np.array(away or [], np.int64) - block.number] = False
                yield block.rows(keep)

    return packed.join(each.hint("merge"), "block", "left").mapInArrow(run, B.fields_of(docs))
