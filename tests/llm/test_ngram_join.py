"""The n-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from tempora.llm import blocks as B
from tempora.llm import pairs
from tempora.llm.op10_ngram_join import keep_one, ngram_components
from tempora.llm.workdir import Scratch

from .fixtures import documents, texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def groups(rows):
    """The group of each row: rows whose sets reach the threshold are linked, ids link nothing."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return sets, [root(k) for k in range(len(rows))]


def brute(rows):
    low = lambda i: -(1 << 63) if i is None else i
    back = lambda i: None if i == -(1 << 63) else i
    sets, group = groups(rows)
    least = {g: min(low(rows[k][0]) for k in range(len(rows)) if group[k] == g) for g in set(group)}
    return sorted(((rows[k][0], len(sets[k]), back(least[group[k]])) for k in range(len(rows))), key=str)


def near_copies(seed, n=120):
    """Chains and stars of near copies around the threshold, with a passage that many share."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    out = []
    bases = [words(rng, rng.randint(20, 120)) for _ in range(8)]
    for _ in range(n):
        w = rng.choice(bases + out[-20:]).split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(9)}"
        if rng.random() < 0.2:
            w = w[: rng.randint(3, len(w))]
        if rng.random() < 0.2:
            w += passage.split(" ")
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed,block_bytes,tile", [(1, 2000, 1024), (2, 6 << 20, 4), (3, 5000, 3)])
def test_components(spark, monkeypatch, seed, block_bytes, tile):
    monkeypatch.setattr(pairs, "SMALL", 8 if tile > 9 else 2)
    monkeypatch.setattr(pairs, "TILE", tile)
    monkeypatch.setattr(pairs, "SPREAD", 64 if tile > 9 else 3)
    monkeypatch.setattr(pairs, "BEST", 1)
    monkeypatch.setattr(B, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(B, "bucket_count", lambda *_: 3)
    rows = list(enumerate(texts(seed, 40) + near_copies(seed)))
    rows += [(None, rows[60][1]), (3, rows[70][1]), (3, "another text under an id that is there"), (70, rows[70][1]), (900, rows[61][1].upper())]
    got = sorted(map(tuple, ngram_components(documents(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_real(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, ngram_components(docs).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert ngram_components(documents(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_components(documents(spark, [(4, None), (5, "")])).orderBy("doc_id").collect()] == [(4, 0, 4), (5, 0, 5)]


def test_tiles(spark):
    """All pairs of different components that reach the threshold leave the tiles, each once a tile."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 62, 60, dtype=np.uint64)
    sets = []
    for _ in range(40):
        own = base.copy()
        own[rng.random(60) < rng.random() * 0.3] = rng.integers(1, 1 << 62, dtype=np.uint64)
        sets.append(np.unique(own))
    rows = [(k, len(s), 0, int(k % 3), 9, len(sets), pairs.bitmap(s).tolist(), [9]) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, n long, alone long, comp long, key long, m long, bits array<long>, keys array<long>")
    got = {(r.a, r.b) for r in pairs.tiled(df, 75).collect()}
    for a in range(40):
        for b in range(a + 1, 40):
            both = len(np.intersect1d(sets[a], sets[b]))
            if a % 3 != b % 3 and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in got
    assert all(a < b and a % 3 != b % 3 for a, b in got)


@pytest.mark.parametrize("one_task", [1, 1 << 16])
def test_union_find(spark, one_task):
    """Components of paths in any order of names, stars, cycles and repeated edges, by rounds and by one task."""
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(200)] + [(900 - 2 * i, 902 - 2 * i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 80)] + [(3000, 3001), (3001, 3002), (3002, 3000), (4000, 4000)]
    edges += [tuple(int(x) for x in rng.integers(5000, 5400, 2)) for _ in range(180)]
    edges += edges[:20]
    got = {r.node: r.comp for r in pairs.components(spark.createDataFrame(edges, "a long, b long").repartition(5), Scratch(spark), one_task).collect()}
    nodes, root = pairs.roots(*(np.array(x) for x in zip(*edges, strict=True)))
    want = dict(zip(nodes.tolist(), root.tolist(), strict=True))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == linked
    groups_of = lambda f: {frozenset(v for v in linked if f(v) == c) for c in {f(v) for v in linked}}
    assert groups_of(got.get) == groups_of(lambda v: want.get(v, v))
    assert all(got[c] == c for c in set(got.values()))


def test_keep_one(spark, monkeypatch):
    """One row of each group stays, that of the least id; rows without an id or with a shared one are rows of their own."""
    monkeypatch.setattr(B, "BLOCK_BYTES", 3000)
    rng = random.Random(3)
    t, u, z = (words(rng, 30) for _ in range(3))
    rows = [(None, t), (None, u), (5, t), (7, z), (7, None), (None, None), (3, u + " x"), (3, words(rng, 40)), (9, z), (9, z)] + list(enumerate(near_copies(8, 40), 100))
    docs = documents(spark, rows)
    got = sorted(((r.doc_id, r.text) for r in keep_one(docs).collect()), key=str)
    _, group = groups(rows)
    low = lambda k: -(1 << 63) if rows[k][0] is None else rows[k][0]
    want = []
    for g in set(group):
        own = [k for k in range(len(rows)) if group[k] == g]
        want.append(sorted((rows[k] for k in own if low(k) == min(map(low, own))), key=str))
    assert len(got) == len(want)
    left = list(got)
    for options in want:
        assert any(o in left for o in options)
        left.remove(next(o for o in options if o in left))
    assert not left
    assert keep_one(docs).columns == docs.columns
    with pytest.raises(ValueError):
        keep_one(docs.withColumn("doc_id", docs.doc_id.cast("string")))
