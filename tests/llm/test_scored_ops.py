"""Toxicity, quality rules, BPE and sharding against plain Python."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.llm.op1_toxicity import ToxicityParams, toxicity
from tempora.llm.op2_quality_rules import quality_rules
from tempora.llm.op3_bpe import codec, default_pattern, default_ranks, encode, round_trip
from tempora.llm.op9_sharding import shard, shard_digest

from .fixtures import documents, fold, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def figures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def labels_for(spark, rows):
    return spark.createDataFrame([(i, 1, int(bool(t) and "idiot" in t)) for i, t in rows], "doc_id long, quality int, toxic int")


def test_quality_figures(spark):
    rows = list(enumerate(texts(1))) + [(3, "x"), (None, "again"), (99, "\n".join(["same line here"] * 30))]
    out = quality_rules(documents(spark, rows), labels_for(spark, rows)).collect()
    assert len(out) == len(rows)
    want = Counter((i, *figures(t)) for i, t in rows)
    assert Counter(tuple(r)[:6] for r in out) == want
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    ok = [(r.quality, out[r.doc_id].kept) for r in labels.collect() if fold(r.doc_id) == 2 and not out[r.doc_id].base_failed]
    assert sum(q == k for q, k in ok) >= 0.95 * len(ok)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert all(r.held_out == (fold(r.doc_id) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    held = [(r.toxic, out[r.doc_id].score) for r in labels.collect() if fold(r.doc_id) == 2]
    pairs = [(a > b) + 0.5 * (a == b) for y, a in held if y for z, b in held if not z]
    assert sum(pairs) / len(pairs) > 0.75


def test_toxicity_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "you idiot"), (7, "word " * 50_000)]
    out = toxicity(documents(spark, rows), labels_for(spark, rows), ToxicityParams(epochs=1)).collect()
    assert len(out) == 5 and len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    empty = documents(spark, [])
    assert toxicity(empty, labels_for(spark, rows)).count() == 0
    assert toxicity(documents(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 5


def test_bpe_round_trip(spark):
    enc = reference_encoding()
    rows = list(enumerate(texts(2))) + [(500, "word other " * 60_000), (501, "<|endoftext|> \u0085　x​ 12½Ⅷ don't WE'LL \n\n  y")]
    out = {r.doc_id: r for r in round_trip(documents(spark, rows)).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    got = encode(documents(spark, rows)).select("doc_id", "ids").collect()
    assert all(list(r.ids) == enc.encode_ordinary(dict(rows)[r.doc_id] or "") for r in got)
    with pytest.raises(ValueError, match="already has"):
        encode(documents(spark, rows), into="lang")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("ab \n\t\u00a0\u3000é'sD1,.", max_size=60))
def test_bpe_any_text(text):
    c, enc = codec(default_ranks(), default_pattern()), reference_encoding()
    data = np.frombuffer(text.encode(), np.uint8)
    ids, bounds, _ = c.encode(data, np.array([0, len(data)]))
    assert list(bounds) == [0, len(ids)]
    assert list(ids) == enc.encode_ordinary(text)
    assert c.decode_text(ids) == text
    assert [i for i, _, _ in c.encode_with_offsets(text)] == list(ids)


def test_sharding(spark):
    rows = list(enumerate(texts(3, 300))) + [(5, "x"), (5, "x"), (None, "none"), (None, None)]
    out = shard_digest(documents(spark, rows)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    for s in range(16):
        slots = sorted(r.slot for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r["shard"], 16) for r in out)
    where = {}
    for r in out:
        assert where.setdefault(r.doc_id, r["shard"]) == r["shard"]
    small = shard(documents(spark, rows).drop("score", "kept"), bucket_bytes=1000)
    for s in range(16):
        slots = sorted(r.slot for r in small.where(small["shard"] == s).collect())
        assert slots == list(range(len(slots)))
    assert shard_digest(documents(spark, [])).count() == 0
    with pytest.raises(ValueError, match="already has"):
        shard(documents(spark, rows).withColumnRenamed("score", "slot"))
