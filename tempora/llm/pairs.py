"""Connected components of sets whose Jaccard similarity reaches a threshold.

``nodes`` has one row for each different set: node (a long), n (its size), keys. Keys are made so that two sets
that reach the threshold share one. Where they are a prefix of an order of all members, place is that of the first, and the
members before it are in no other set. The members
themselves (sorted 64-bit hashes as bytes) are fetched only for nodes that share a key. Only connectedness is asked for, so not
all pairs of a key's group are made:

1. sets of like size (bands a factor of 4/3 wide; sets that can reach the threshold are in one
   band or in neighbouring ones) that share a key have a pivot in their band and in the band below: the least odd of them, ties
   drawn by hash. A node is compared with the first of the pivots of its keys, so many copies of one text all meet one pivot;
2. what is linked becomes one component (see ``components``); groups that lie in one component are done. Small others are joined with themselves,
   pairs of different components only;
   Nodes of large groups can meet their likeliest partners, by bitmaps, before: most of what is left of near copies joins then;
3. larger ones are dealt into tiles of at most ``TILE`` nodes of a group, and each pair of tiles is one task's: bitmaps of all its nodes are held
   against those of the nodes outside its largest component at once, and only pairs that pass leave it. So no link is lost, whatever the groups look like, and what a
   task holds is bounded.

A pair is first held against hashed bitmaps: each set bit that the other has not is at least one member
that the other has not, which bounds the overlap from above. Pairs that pass are compared exactly, by
intersecting sorted arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import group_starts
from .workdir import Scratch

BITMAP_LONGS = 32
#: Groups of more nodes than these are compared in tiles.
SMALL = 8
TILE = 1024
#: Nodes of groups of more nodes than these can meet so many of their likeliest partners first.
SPREAD = 64
BEST = 3
#: Edges of which one task finds the components.
ONE_TASK = 1 << 16


def band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(4 / 3)))).cast("int")


def bitmap(members: np.ndarray) -> np.ndarray:
    """64 * BITMAP_LONGS bits; each member sets one."""
    bits = np.zeros(64 * BITMAP_LONGS, np.uint8)
    bits[(members >> np.uint64(20)).astype(np.int64) % (64 * BITMAP_LONGS)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def needed(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of sets of these sizes that reaches the threshold."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def overlap_bound() -> Column:
    """The overlap of two sets is no more than either's size less the bits that only it has."""
    lone = lambda x, y: sum((F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(BITMAP_LONGS)), F.lit(0))
    a, b = F.col("a_bits"), F.col("b_bits")
    return F.least(F.col("a_n") - lone(a, b), F.col("b_n") - lone(b, a))


Unpack = Callable[[list[bytes]], list[np.ndarray]]


def sorted_hashes(members: list[bytes]) -> list[np.ndarray]:
    """Members that travel as their sorted 64-bit hashes."""
    return [np.frombuffer(x, np.uint64) for x in members]


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many members two sorted arrays share."""
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    if not len(y):
        return 0
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum())


def verified(pairs: DataFrame, nodes: DataFrame, percent: int, unpack: Unpack) -> DataFrame:
    """Those of the pairs (a, b) that reach the threshold."""
    if "bits" in nodes.columns:
        light = nodes.select("node", "n", "bits")
        side = lambda x: light.select(*(F.col(c).alias(x if c == "node" else f"{x}_{c}") for c in light.columns))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(overlap_bound() >= needed(F.col("a_n"), F.col("b_n"), percent)).select("a", "b")
    sets = nodes.select("node", "members")
    whole = pairs.join(sets.withColumnsRenamed({"node": "a", "members": "a_members"}), "a").join(sets.withColumnsRenamed({"node": "b", "members": "b_members"}), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                a, b = (part.column(c).to_pylist() for c in (0, 1))
                # A pivot is in many pairs; each set is unpacked once.
                body = dict(zip(b, part.column(3), strict=True)) | dict(zip(a, part.column(2), strict=True))
                sets = dict(zip(body, unpack([x.as_py() for x in body.values()]), strict=True))
                for x, y in ((sets[i], sets[j]) for i, j in zip(a, b, strict=True)):
                    both = overlap(x, y)
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return whole.select("a", "b", "a_members", "b_members").mapInArrow(compare, "a long, b long")


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes of some edges that are not their component's root, the least node."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    up = np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        split = low != high
        if not split.any():
            moved = up != np.arange(len(nodes))
            return nodes[moved], nodes[up[moved]]
        np.minimum.at(up, high[split], low[split])
        while (up[up] != up).any():
            up = up[up]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars: (a, b) of each node and the root of its component among them."""
    got = list(batches)
    if got:
        a, b = roots(*(np.concatenate([x.column(c).to_numpy() for x in got]) for c in (0, 1)))
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame, scratch: Scratch, one_task: int = ONE_TASK) -> DataFrame:
    """(node, comp) of every node of an edge (a, b); comp is one of the component's nodes.

    Each task first makes stars of its own edges. While more than ``one_task`` edges are left, every node then points to the first of its
    neighbours and itself in an order by hash, and on to where that one points; edges are carried on between what is pointed to, so their number
    falls by a factor in every round. The rest is one task's, of bounded size. Going back through the rounds, a node takes the component
    of the node that it pointed to; rounds shrink, so all of them together cost little more than the first.
    """
    left = scratch.keep(edges.select("a", "b").where("a != b").distinct().mapInArrow(_forest, "a long, b long"))
    steps = []
    while (n := left.count()) > one_task:
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own, best = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("x")), F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("x"))
        point = scratch.keep(both.groupBy(own.alias("own")).agg(F.min(best).alias("best")).select(F.col("own.x").alias("node"), F.least("own", "best")["x"].alias("up")))
        further = point.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        step = scratch.keep(point.join(further, "up").select("node", F.col("upper").alias("up")).where("node != up"))
        moved = left
        for end in "ab":
            moved = moved.join(step.withColumnsRenamed({"node": end, "up": f"{end}_up"}), end, "left").withColumn(end, F.coalesce(f"{end}_up", end)).drop(f"{end}_up")
        fewer = scratch.keep(moved.where("a != b").distinct().mapInArrow(_forest, "a long, b long"))
        scratch.drop(left, point)
        steps.append(step)
        left = fewer
    # Stars of several tasks may share nodes.
    found = (left.coalesce(1).mapInArrow(_forest, "a long, b long") if n else left).withColumnsRenamed({"a": "node", "b": "comp"})
    found = scratch.keep(found)
    scratch.drop(left)
    for step in reversed(steps):
        back = step.join(found.select(F.col("node").alias("up"), "comp"), "up", "left").select("node", F.coalesce("comp", "up").alias("comp"))
        new = scratch.keep(back.union(found))
        scratch.drop(step, found)
        found = new
    return found.union(found.select(F.col("comp").alias("node"), "comp").distinct())


def star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b) of each node with the first pivot of its keys in its band, and the first in the band below.

    The entries of a key are read in the order of (band, rank as a pivot), so a task only remembers the pivots of two bands."""
    columns = ["key", "band", "odd", "h", "node", "n", "alone"]
    dealt = entries.select("key", "band", "odd", F.xxhash64("node", F.lit(1)).alias("h"), "node", "n", "alone").repartition("key").sortWithinPartitions(*columns[:5])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {c: np.zeros(0, np.int64) for c in columns}
        for batch in batches:
            ahead = len(known["key"])
            at = {c: np.concatenate([known[c], batch.column(k).to_numpy()]) for k, c in enumerate(columns)}
            starts = group_starts(at["key"], at["band"])
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at["key"]))))
            beside = np.zeros(len(starts), bool)
            beside[1:] = (at["key"][starts[1:]] == at["key"][starts[:-1]]) & (at["band"][starts[1:]] == at["band"][starts[:-1]] + 1)
            new = np.arange(ahead, len(group))
            x, pivot, below = [], [], []
            for under, own in ((0, new), (1, new[beside[group[new]]])):
                x.append(own)
                pivot.append(starts[group[own] - under])
                below.append(np.full(len(own), under, np.int32))
            x, pivot, below = (np.concatenate(v) for v in (x, pivot, below))
            n, m = at["n"][x], at["n"][pivot]
            least = -(-(n + m) * percent // (100 + percent))
            fits = (at["node"][x] != at["node"][pivot]) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (np.minimum(n - at["alone"][x], m - at["alone"][pivot]) >= least)
            x, pivot, below = x[fits], pivot[fits], below[fits]
            yield pa.record_batch([pa.array(at["node"][x]), pa.array(below), pa.array(at["odd"][pivot].astype(np.int32)), pa.array(at["h"][pivot]), pa.array(at["node"][pivot])], ["x", "below", "odd", "h", "p"])
            last = starts[-2:] if len(starts) > 1 and beside[-1] else starts[-1:]
            known = {c: at[c][last] for c in columns}

    pivots = dealt.mapInArrow(run, "x long, below int, odd int, h long, p long")
    first = pivots.groupBy("x", "below").agg(F.min(F.struct("odd", "h", "p")).alias("p")).select("x", "p.p")
    return first.select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b")).distinct()


def near_components(nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch, unpack: Unpack = sorted_hashes, shared_keys: bool = False, best_first: bool = False) -> DataFrame:
    """(node, comp) of every node that is linked with another; see the module's text.

    ``shared_keys``: all keys are known to be shared, so ``fetch`` need not be told of nodes, and what it gives is kept already. ``best_first``: nodes of large groups meet their likeliest partners before all others.

    ``fetch`` gives (node, n, members, and bitmaps as bits where sets are held against those first) for a table of nodes, and ``unpack`` the sorted hashes of some
    members."""

    def with_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(1)
            bits = [bitmap(x).tolist() for at in range(0, len(members), 256) for x in unpack([m.as_py() for m in members.slice(at, 256)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64()))], names=["node", "bits"])

    given, nodes_columns = nodes, nodes.columns
    alone = F.col("place") if "place" in nodes.columns else F.lit(0)
    odd = F.col("odd") if "odd" in nodes.columns else alone * 16 / F.col("n")
    entries = nodes.select("node", F.col("n").cast("long").alias("n"), band(F.col("n")).alias("band"), alone.cast("long").alias("alone"), odd.cast("int").alias("odd"), F.posexplode("keys").alias("at", "key"))
    if not shared_keys:
        met = entries.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("key")
        entries = entries.join(met, "key")
    entries = scratch.keep(entries)
    fetched = fetch(entries.select("node").distinct())
    nodes = fetched if shared_keys else scratch.keep(fetched)
    # Members that one set has alone are in no overlap.
    least = needed(F.col("a_n"), F.col("b_n"), percent)
    fits = (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent) & (F.least(F.col("a_n") - F.col("a_alone"), F.col("b_n") - F.col("b_alone")) >= least)

    def undone(comps: DataFrame) -> DataFrame:
        """The entries of keys whose nodes are not all in one component yet, with their components and the number of entries."""
        of_key = Window.partitionBy("key")
        with_comp = entries.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        return scratch.keep(with_comp.withColumns({"lo": F.min("comp").over(of_key), "hi": F.max("comp").over(of_key), "m": F.count(F.lit(1)).over(of_key)}).where("lo != hi").drop("lo", "hi"))

    def grown(comps: DataFrame, pairs: DataFrame) -> DataFrame:
        """The components with those pairs that reach the threshold; what the pairs link are the components so far."""
        links = verified(pairs, nodes, percent, unpack)
        for end in "ab":
            links = links.join(comps.withColumnsRenamed({"node": end, "comp": f"{end}_comp"}), end, "left").withColumn(end, F.coalesce(f"{end}_comp", end)).drop(f"{end}_comp")
        more = scratch.keep(components(links, scratch))
        further = more.select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
        old = comps.join(further, "comp", "left").select("node", F.coalesce("whole", "comp").alias("comp"))
        new = scratch.keep(old.union(more.join(comps.select("node"), "node", "left_anti")))
        scratch.drop(comps, more)
        return new

    def bits_of(wanted: DataFrame) -> DataFrame:
        some = nodes.join(wanted, "node")
        return some.select("node", "bits") if "bits" in nodes.columns else some.select("node", "members").mapInArrow(with_bits, "node long, bits array<long>")

    first = scratch.keep(components(verified(star_pairs(entries, percent), nodes, percent, unpack), scratch))
    left = undone(first)
    if best_first and not (large := left.where(F.col("m") > SPREAD)).isEmpty():
        top = large.groupBy("node").agg(F.max(F.struct("m", "key")).alias("top")).select("node", F.col("top.key").alias("key"))
        first = grown(first, tiled(large.join(top, ["node", "key"]).join(bits_of(top.select("node")), "node"), percent, BEST).distinct())
        scratch.drop(left)
        left = undone(first)
    few, many = left.where(F.col("m") <= SMALL), left.where(F.col("m") > SMALL)
    x, y = (few.select("key", *(F.col(c).alias(f"{k}_{c}" if c != "node" else k) for c in ("node", "n", "band", "comp", "alone", "at"))) for k in "ab")
    # Of the members before a shared key, none that is alone is shared, nor more than the other has before it.
    possible = F.least("a_at", "b_at") + F.least(F.col("a_n") - F.col("a_alone") - F.col("a_at"), F.col("b_n") - F.col("b_alone") - F.col("b_at"))
    likely = (possible >= least) if "place" in nodes_columns else F.lit(True)
    rest = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("a_comp") != F.col("b_comp")) & (F.abs(F.col("a_band") - F.col("b_band")) <= 1) & fits & likely)
    # A pair leaves the tiles for its least key only.
    in_many = many.select("node").distinct()
    keyed = given.select("node", "keys").join(in_many, "node")
    pairs = rest.select("a", "b").union(tiled(many.join(keyed.join(bits_of(in_many), "node"), "node"), percent)).distinct()
    found = grown(first, pairs)
    scratch.drop(left, entries, *([] if shared_keys else [nodes]))
    return found


def tiled(entries: DataFrame, percent: int, best: int | None = None) -> DataFrame:
    """Pairs (a, b) of different components in each key's group that their bitmaps and lone members leave possible; ``best``: of each node only so many with the greatest
    bounds in a tile."""
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("node"), tiles)
    dealt = entries.withColumn("_t", tile).withColumn("_s", F.explode(F.sequence(F.lit(0), tiles - 1)))
    dealt = dealt.select("key", F.least("_t", "_s").cast("int").alias("t"), F.greatest("_t", "_s").cast("int").alias("s"), "node", "n", "alone", "comp", "bits", F.col("_t").cast("int").alias("own"), *([] if best else ["keys"]))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        node, n, alone, comp, own = (table.column(c).to_numpy() for c in ("node", "n", "alone", "comp", "own"))
        bits = np.array(table.column("bits").combine_chunks().flatten()).view(np.uint64).reshape(-1, BITMAP_LONGS)
        _, place = np.unique(comp, return_inverse=True)
        largest = np.bincount(place).argmax()
        lower = np.zeros((len(node), 1), bool)
        if not best:
            # Of each node, which of the keys below this one it has.
            lists = table.column("keys").combine_chunks()
            flat = lists.flatten().to_numpy()
            of = np.repeat(np.arange(len(node)), np.asarray(lists.value_lengths()))
            under = flat < key[0].as_py()
            below, column = np.unique(flat[under], return_inverse=True)
            lower = np.zeros((len(node), max(1, len(below))), bool)
            lower[of[under], column] = True
        shared, across = n - alone, key[1].as_py() != key[2].as_py()
        a, b = [], []
        for i in np.flatnonzero(place != largest):
            # Each pair once: with the largest component from here, among the others from the later one.
            other = (place != place[i]) & ((place == largest) | (np.arange(len(node)) < i))
            if across:
                other &= own != own[i]
            j = np.flatnonzero(other)
            least = -(-(n[i] + n[j]) * percent // (100 + percent))
            j = j[(np.minimum(shared[i], shared[j]) >= least) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)]
            least = -(-(n[i] + n[j]) * percent // (100 + percent))
            here = n[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(axis=1)
            there = n[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(axis=1)
            bound = np.minimum(here, there)
            good = bound >= least
            if best:
                j, bound, least = j[good], bound[good], least[good]
                j = j[np.argsort(least - bound, kind="stable")[:best]]
            else:
                j = j[good]
            j = j[~(lower[j] & lower[i]).any(axis=1)]
            a.append(np.minimum(node[i], node[j]))
            b.append(np.maximum(node[i], node[j]))
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        keep = a != b
        return pa.table([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return dealt.groupBy("key", "t", "s").applyInArrow(compare, "a long, b long")
