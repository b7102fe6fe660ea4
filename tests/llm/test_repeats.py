"""Suffix dedup and winnowing against brute force."""

import hashlib

import pytest

from tempora.llm import blocks as B
from tempora.llm.op6_suffix_dedup import remove_repeats, repeats_digest
from tempora.llm.op7_fingerprints import fingerprints

from .fixtures import documents, texts


def brute_repeats(rows, width=50):
    first = {}
    body = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: (i is not None, i or 0)
    for i, b in body:
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            first[w] = min(first.get(w, rank(i)), rank(i))
    out = []
    for i, b in body:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < rank(i):
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    """Texts with shared passages in different places, repeated within and over documents."""
    t = [x for x in texts(seed, 60) if x]
    p = "This passage of well over fifty bytes is in many documents, each time between other words."
    q = "abcdefgh" * 20
    return texts(seed, 60) + [f"{x[:40]} {p} {x[40:90]}" for x in t[:25]] + [p + p, q, q[3:] + p[:70], p[10:70], p[11:61], "z" * 49, "z" * 50, "z" * 51]


@pytest.mark.parametrize("block_bytes", [1500, 6 << 20])
def test_suffix_dedup(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(B, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(B, "bucket_count", lambda *_: 5)
    rows = list(enumerate(passages(4))) + [(None, "no id here " * 9), (90, "no id here " * 9), (11, passages(4)[70]), (11, passages(4)[70])]
    rows.reverse()
    got = sorted(map(tuple, repeats_digest(documents(spark, rows)).collect()), key=str)
    assert got == brute_repeats(rows)


def test_suffix_dedup_real(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, repeats_digest(docs).collect()), key=str) == brute_repeats(rows)


def test_suffix_dedup_empty(spark):
    assert repeats_digest(documents(spark, [])).count() == 0
    assert [tuple(r) for r in remove_repeats(documents(spark, [(1, None)])).collect()] == [(1, 0, 0, 0, bytearray(b""))]


def test_fingerprints(spark):
    rows = list(enumerate(texts(5, 60)))
    out = {r.doc_id: r for r in fingerprints(documents(spark, rows)).collect()}
    assert len(out) == len(rows)
    t = [x or "" for _, x in rows]
    for i, text in enumerate(t):
        half = len(text) // 2
        edited = text[: len(text) - half] + t[(i + 1) % len(t)][:half]
        assert out[i].n_chars == len(text)
        assert out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
        if edited == text:
            assert out[i].fingerprint == out[i].edited_fingerprint and out[i].near_edited == 1
    by = {}
    for i, text in enumerate(t):
        assert by.setdefault(text, out[i].fingerprint) == out[i].fingerprint


def test_fingerprint_edges(spark):
    rows = [(None, "a b c d"), (3, "x y z"), (3, "x y z"), (3, "w y z q r s t"), (9, None)]
    out = fingerprints(documents(spark, rows)).collect()
    assert len(out) == 5
    assert {r.edited_sha256 for r in out if r.doc_id is None} == {hashlib.sha256(b"a b w y").hexdigest()}
    assert fingerprints(documents(spark, [])).count() == 0
    (one,) = fingerprints(documents(spark, [(1, "abcd")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1


def test_winnowing_guarantee(spark):
    """A run of k + window - 1 shared pieces shares a choice; choices are rightmost minima of their windows."""
    from pyspark.sql import functions as F

    from tempora.llm.op7_fingerprints import K_PIECES, WINDOW, with_fingerprint

    shared = " ".join(f"s{i}" for i in range(K_PIECES + WINDOW - 1))
    rows = [(i, f"{' '.join(f'p{i}x{j}' for j in range(i % 7))} {shared} {' '.join(f'q{i}x{j}' for j in range(i % 5))}") for i in range(30)] + [(99, "aa " * 40)]
    out = with_fingerprint(documents(spark, rows), "text", "fp").select("doc_id", F.transform("fp", lambda x: F.shiftright(x, 32)).alias("h"), "fp").collect()
    sets = [set(r.h) for r in out if r.doc_id < 99]
    assert set.intersection(*sets)
    (same,) = [r for r in out if r.doc_id == 99]
    positions = [(1 << 31) - 1 - (x & ((1 << 32) - 1)) for x in same.fp]
    assert positions == list(range(WINDOW - 1, 38))
