"""Line dedup, importance resampling, mixing and the pipeline against plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tempora.llm import blocks as B
from tempora.llm import op4_quality_resampling as op4
from tempora.llm.op4_quality_resampling import ResamplingParams, best_floor, kth_greatest, quality_sample, resample
from tempora.llm.op5_mixing import MixingParams, mix, mixed, passes, solve_exponent, weights
from tempora.llm.op8_line_dedup import SHINGLE, band_keys, dedup_lines, line_digest, line_report, line_shingles

from .fixtures import documents, fold, texts, words

SF = "/root/testdata/sf0.01"


def shingles(line):
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def brute_lines(rows):
    """Exact components of all different lines at Jaccard 0.75; the first place of each stays."""
    low = lambda i: (i is not None, i or 0)
    places = defaultdict(list)
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\v\f\r"):
                places[line].append((low(i), k))
    lines = list(places)
    sets = [shingles(x) for x in lines]
    up = list(range(len(lines)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                up[root(a)] = root(b)
    first = {}
    for a, line in enumerate(lines):
        first[root(a)] = min(first.get(root(a), ((True, 1 << 60), 0)), min(places[line]))
    stays = {line: first[root(a)] for a, line in enumerate(lines)}
    out = []
    for i, t in rows:
        kept, n, gone = [], 0, 0
        for k, line in enumerate((t or "").split("\n")):
            if line in stays:
                n += 1
                if stays[line] != (low(i), k):
                    gone += 1
                    continue
            kept.append(line)
        out.append((i, n, gone, kept))
    return out


def line_rows(seed):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(4, 25)) for _ in range(40)]
    out = texts(seed, 30)
    for _ in range(40):
        some = [rng.choice(base) for _ in range(rng.randint(1, 6))]
        for k in range(len(some)):
            if rng.random() < 0.4:
                w = some[k].split(" ")
                w[rng.randrange(len(w))] = rng.choice(["new", "é", "other"])
                some[k] = " ".join(w)
        out.append("\n".join(some) + rng.choice(["", "\n", "\r\n", "\n\n"]))
    return list(enumerate(out))


@pytest.mark.parametrize("block_bytes", [2500, 6 << 20])
def test_lines(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(B, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(B, "bucket_count", lambda *_: 3)
    rows = line_rows(6) + [(None, "A line that only the row without an id and one other have.\nx"), (70, "A line that only the row without an id and one other have.")]
    got = {r.doc_id: r for r in line_report(documents(spark, rows)).collect()}
    for i, n, gone, kept in brute_lines(rows):
        assert (got[i].n_lines, got[i].n_removed) == (n, gone), i
        assert [x for x in got[i].text.split("\n") if x] == [x for x in kept if x]
    left = dedup_lines(documents(spark, rows), drop_emptied=False)
    assert left.columns == documents(spark, rows).columns
    assert Counter((r.doc_id, r.text, r.score) for r in left.collect()) == Counter((i, got[i].text, (i or 0) * 2) for i, _ in rows)
    assert all(r.n_chars == len(r.text) for r in left.collect())
    emptied = {i for i, r in got.items() if r.n_removed and r.n_lines == r.n_removed}
    assert {r.doc_id for r in dedup_lines(documents(spark, rows)).collect()} == set(got) - emptied


def test_lines_edges(spark):
    assert line_digest(documents(spark, [])).count() == 0
    same = "the very same text\non two lines"
    out = sorted(tuple(r)[:3] for r in line_digest(documents(spark, [(1, same), (1, same), (2, same), (3, None)])).collect())
    assert out == [(1, 2, 0), (1, 2, 2), (2, 2, 2), (3, 0, 0)]


def test_resampling(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in quality_sample(docs, labels).collect()}
    assert len(out) == docs.count()
    held = [(r.quality, out[r.doc_id].kept) for r in labels.collect() if fold(r.doc_id) == 2]
    assert sum(k for q, k in held if q) >= 0.97 * sum(q for q, _ in held)
    assert sum(not k for q, k in held if not q) >= 0.9 * sum(1 - q for q, _ in held)
    few = quality_sample(docs, labels, ResamplingParams(k=25)).where("selected").count()
    assert few == 25


def test_resampling_by_hand(spark, monkeypatch):
    """Ratios, weights, the floor and the drawn set against counters."""
    monkeypatch.setattr(B, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(B, "bucket_count", lambda *_: 3)
    rows = list(enumerate(texts(4, 60))) + [(7, texts(4, 60)[7]), (None, "x y z"), (100, "the of " * 4000)]
    docs = documents(spark, rows)
    rng = random.Random(2)
    given = [(i, rng.randint(0, 1), 0) for i in range(0, 55)] + [(3, 0, 0), (3, 1, 0), (5, None, 0), (6, 7, 0)]
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    p = ResamplingParams(bits=6, slot_grams=3)
    both_ways = {i for i, q, _ in given if q in (0, 1) and any(j == i and r == 1 - q for j, r, _ in given)}
    label = {i: q for i, q, _ in given if q in (0, 1) and i not in both_ways}

    def grams(text, slots):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return Counter(int(x) for x in op4.ngrams(data, np.array([0, len(data)]), slots)[1])

    raw = sum(max(0, 2 * len((t or "").split()) - 1) for _, t in rows)
    slots = max(1 << p.bits, -(-raw // p.slot_grams))
    bags = [grams(t, slots) for _, t in rows]
    total, target = Counter(), Counter()
    for (i, _), bag in zip(rows, bags, strict=True):
        total.update(bag)
        if label.get(i) == 1 and fold(i) in (0, 1):
            target.update(bag)
    assert sum(total.values()) == raw

    def ratio(slot):
        share = total[slot] * sum(target.values()) / raw
        return round(math.log((target[slot] + p.smooth * share + 0.5) / ((1 + p.smooth) * share + 0.5)) * op4.STEPS) / op4.STEPS

    want = sorted((sum(c * ratio(s) for s, c in bag.items()), sum(c * ratio(s) for s, c in bag.items()) / max(1, sum(bag.values()))) for bag in bags)
    keyed = op4.weighted(docs.select("doc_id", "text"), labels, p).collect()
    assert np.array(sorted((r.log_weight, r.mean_ratio) for r in keyed)) == pytest.approx(np.array(want))
    for k in (1, 10, 40):
        got = resample(docs, labels, ResamplingParams(bits=6, slot_grams=3, k=k))
        edge = sorted((r.key for r in keyed), reverse=True)[k - 1]
        assert sorted(r.mean_ratio for r in got.where("selected").collect()) == pytest.approx(sorted(r.mean_ratio for r in keyed if r.key >= edge))
    held = {i: q for i, q in label.items() if fold(i) == 3}
    value = {r.doc_id: r.mean_ratio for r in keyed}
    floor = best_floor(*(np.array([value[i] for i, q in held.items() if q == y]) for y in (1, 0)), p.good_cost)
    assert resample(docs, labels, p).where("selected").count() == sum(r.mean_ratio >= floor for r in keyed)
    assert resample(docs, labels, p).columns == [*docs.columns, "log_weight", "mean_ratio", "selected"]
    for name in ("key", "selected", "log_weight"):
        with pytest.raises(ValueError, match="already has"):
            resample(docs.withColumnRenamed("lang", name), labels)
    with pytest.raises(ValueError):
        ResamplingParams(temperature=0.0)


def test_floor():
    good, bad = np.array([1.0, 2.0, 3.0]), np.array([-3.0, -2.0, 1.5])
    assert best_floor(good, bad, 20.0) == pytest.approx(-0.5)
    assert best_floor(good, bad, 0.1) == pytest.approx(1.75)
    assert best_floor(good, bad[:0], 1.0) is None


def keys_of(lines):
    data = [x.encode() for x in lines]
    ends = np.cumsum([len(x) for x in data])
    return band_keys(*line_shingles(np.frombuffer(b"".join(data), np.uint8), ends - [len(x) for x in data], ends), len(data))


@pytest.mark.parametrize("low, high", [(12, 18), (18, 28), (28, 42), (42, 63), (63, 120)])
def test_near_lines_share_a_band_at_every_length(low, high):
    """Lines with cut or added ends, near enough by brute force: they propose each other however few shingles they have."""
    rng = random.Random(low)
    pairs = []
    while len(pairs) < 2000:
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(low, high)))
        b = a[rng.randint(0, 3) : len(a) - rng.randint(0, 3)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 3)))
        x, y = shingles(a), shingles(b)
        if a != b and 100 * len(x & y) >= 75 * len(x | y):
            pairs.append((a, b))
    missed = 1 - (keys_of([a for a, _ in pairs]) == keys_of([b for _, b in pairs])).any(axis=1).mean()
    print(low, high, "missed", missed)
    assert missed <= 0.01


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_resampling_keeps_and_rejects_as_the_corpus_grows(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r.kept for r in quality_sample(docs, labels).select("doc_id", "kept").collect()}
    held = [(r.quality, out[r.doc_id]) for r in labels.collect() if fold(r.doc_id) == 2]
    good, bad = ([k for q, k in held if q == y] for y in (1, 0))
    print(sf, "good kept", sum(good) / len(good), "bad kept", sum(bad) / len(bad), "share kept", sum(out.values()) / len(out))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_resampling_edges(spark):
    rows = list(enumerate(texts(8))) + [(None, "x"), (3, "x"), (3, "x")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_sample(documents(spark, rows), none).collect()
    assert len(out) == len(rows) and all(r.selected and r.log_weight == 0 for r in out)
    assert quality_sample(documents(spark, []), none).count() == 0
    values = [random.Random(1).randrange(1 << 62) for _ in range(500)] + [7] * 20
    keys = spark.createDataFrame([(v,) for v in values], "k long")
    for k in (1, 2, 250, 505, 520):
        assert kth_greatest(keys, "k", k) == sorted(values, reverse=True)[k - 1]
    assert kth_greatest(keys, "k", 0) is None


def test_exponent():
    shares = {"a": 900, "b": 90, "c": 10}
    for limit in (1.0, 1.5, 3.0, 50.0):
        p = MixingParams(repeat_limit=limit)
        e = solve_exponent(shares, p)
        often = passes(shares, weights(shares, e))
        assert max(often.values()) <= limit + 1e-9 and min(often.values()) == pytest.approx(1)
        assert e == 0 or max(often.values()) == pytest.approx(limit, abs=1e-6)
    import math

    e = solve_exponent(shares, MixingParams(repeat_limit=None, entropy=0.6))
    w = weights(shares, e)
    assert -sum(x * math.log(x) for x in w.values()) / math.log(3) == pytest.approx(0.6, abs=1e-6)
    # Beyond the shares themselves, and limits that cannot be met.
    e = solve_exponent(shares, MixingParams(repeat_limit=None, entropy=0.1))
    w = weights(shares, e)
    assert e > 1 and -sum(x * math.log(x) for x in w.values()) / math.log(3) == pytest.approx(0.1, abs=1e-6)
    for bad, what in ((MixingParams(repeat_limit=2.0, budget=5000), shares), (MixingParams(repeat_limit=None, entropy=0.1), {"a": 5, "b": 5}), (MixingParams(repeat_limit=2.0, budget=5000), {"a": 1000})):
        with pytest.raises(ValueError, match="no exponent"):
            solve_exponent(what, bad)


def test_mixing_repeated_rows(spark):
    """Fifty equal rows of two tokens: the budget is met, not passed by the whole group."""
    rows = [(1, "a b", None, "s", None)] * 50 + [(k, "x y z", None, "t", None) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mix(docs, MixingParams(repeat_limit=None, budget=60)).collect()
    for s in "st":
        assert abs(sum(len(r.text.split()) for r in out if r.source == s) - 30) <= 3


def test_mixed_order(spark):
    """Files of the mix follow its order, and every part of it has the sources in about the same proportions."""
    rng = random.Random(4)
    data = [(i, words(rng, rng.randint(5, 12)), None, rng.choice("aaaab"), None) for i in range(2000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    p = MixingParams(block_tokens=100)
    want = [r.doc_id for r in mix(docs, p).orderBy("place", "position", "doc_id").collect()]
    out = mixed(docs, p).collect()
    assert [r.doc_id for r in out] == want and mixed(docs, p).columns == docs.columns
    share = [sum(r.source == "b" for r in part) / len(part) for part in (out[: len(out) // 2], out[len(out) // 2 :])]
    assert abs(share[0] - share[1]) < 0.1


@pytest.mark.parametrize("p", [MixingParams(block_tokens=50), MixingParams(repeat_limit=4.0, block_tokens=1 << 20), MixingParams(repeat_limit=2.0, budget=900, block_tokens=40)])
def test_mixing(spark, p):
    rng = random.Random(9)
    data = [(i, words(rng, rng.randint(1, 12)), None, rng.choice(["hot"] * 6 + ["b", None]), None) for i in range(300)] + [(7, None, None, "b", None), (None, "", None, "b", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    size = {d[0]: max(1, len((d[1] or "").split())) for d in data}
    totals = Counter()
    for d in data:
        totals[d[3]] += max(1, len((d[1] or "").split()))
    out = mix(docs, p).collect()
    w = weights(totals, solve_exponent(totals, p))
    whole = p.budget or max(totals[s] / w[s] for s in totals)
    for s, t in totals.items():
        rows = [r for r in out if r.source == s]
        drawn = sum(max(1, len((r.text or "").split())) for r in rows)
        assert rows[0].weight == pytest.approx(w[s]) if rows else w[s] * whole < 1
        assert abs(drawn - w[s] * whole) <= max(size.values()) + 1
        times = Counter(r.doc_id for r in rows if r.doc_id != 7)
        if times and len(times) > 1:
            assert max(times.values()) - min(times.get(d[0], 0) for d in data if d[3] == s and d[0] != 7) <= 1
        assert t > 0
    if p.budget is None:
        assert {r.doc_id for r in out} == {d[0] for d in data}
    with pytest.raises(ValueError, match="already has"):
        mix(docs.withColumnRenamed("lang", "weight"), p)
    assert mix(docs.limit(0), p).count() == 0


def test_pipeline(spark):
    import public_tokenizers
    import tiktoken  # noqa: F401

    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.select("doc_id", "text").collect()
    seen = docs
    for name, stage in c.STAGES[:-1]:
        seen = spark.createDataFrame(stage(spark, seen, sf).collect(), docs.schema)
        assert seen.columns == docs.columns and seen.count() > 0, name
    out = c.run(spark, sf).collect()
    body = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in seen.collect())
    assert Counter((r.doc_id, r.decoded_sha256) for r in out) == body
    assert {r.doc_id for r in out} <= {r.doc_id for r in first}
    assert public_tokenizers.PATTERN


def test_lines_are_found_hashed_and_cut_as_plain_python_does():
    from tempora.llm import op8_line_dedup as op8
    from tempora.llm import textkern as K

    rng = random.Random(4)
    some = ["", "\n", " \n a", "a\n", "é\né\n", "  \t\n  b\n\n", "x" * 300_000, "日本語\n短\n" + "長い" * 90_000, "a\n\r\n  \n b"]
    some += ["\n".join("".join(rng.choice("abc é") for _ in range(rng.randint(0, 400))) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    raw = [t.encode() for t in some]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    text, start, length, number, key = op8.line_index(data, offsets)
    want = [(i, k, x) for i, t in enumerate(raw) for k, x in enumerate(t.split(b"\n")) if x.strip(b" \t\n\v\f\r")]
    assert [(t, k, data[s : s + n].tobytes()) for t, k, s, n in zip(text, number, start, length, strict=True)] == want
    assert np.array_equal(key, K.RangeHash(data)(start, start + length))
    block = B.Block.__new__(B.Block)
    block.number, block.ids, block.offsets, block.data = 0, np.arange(len(raw)), offsets, data
    block.index = lambda: [c.astype(np.uint64) for c in (start, text, length, number, key)]
    lines = op8.Lines(block)
    own = np.arange(len(start))
    parts = [(len(d), e - s) for _, d, s, e in op8.owned_slices(lines, own)]
    assert sum(len(n) for _, n in parts) == len(own) and all(size <= K.CACHE_BYTES or len(n) == 1 for size, n in parts)
    plain = band_keys(*line_shingles(data, lines.start, lines.end), len(own)) >> np.uint64(16)
    assert np.array_equal(op8.owned_bands(lines, own), plain)
    goes = np.array([rng.random() < 0.4 for _ in want])
    gone = {(i, k) for (i, k, _), g in zip(want, goes, strict=True) if g}
    left = [b"".join(x for k, x in enumerate(t.splitlines(True) if b"\r" not in t else [y + b"\n" for y in t.split(b"\n")[:-1]] + [t.split(b"\n")[-1]]) if (i, k) not in gone) for i, t in enumerate(raw)]
    out = op8.without(block, lines, goes)
    out.validate(full=True)
    assert [x.encode() for x in out.to_pylist()] == left


def test_band_counts_and_answers_by_one_sort():
    from tempora.llm import op8_line_dedup as op8

    keys = np.random.default_rng(0).integers(0, 50, (40, op8.BANDS)).astype(np.uint64) * np.uint64(16) + np.arange(op8.BANDS, dtype=np.uint64)
    row = op8.BandRow(0, np.arange(40, dtype=np.int32).tobytes(), B.encode_keys(keys))
    for got, want in zip(row.counts(), B.counted(keys.ravel(), np.repeat(np.arange(40), op8.BANDS)), strict=True):
        assert np.array_equal(got, want)
    assert np.array_equal(row.spread(lambda sent: (sent * np.uint64(3)).astype(np.int64)), keys.astype(np.int64) * 3)
    none = op8.BandRow(0, b"", b"")
    assert len(none.counts()[0]) == 0 and none.spread(lambda sent: np.zeros(len(sent), np.int64)).shape == (0, op8.BANDS)


def test_set_sizes_count_different_shingles():
    from tempora.llm.op8_line_dedup import set_sizes

    rng = random.Random(9)
    lines = ["abcabcabc" * rng.randint(1, 30) if rng.random() < 0.3 else "".join(rng.choice("abé日") for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    data = [x.encode() for x in lines]
    ends = np.cumsum([len(x) for x in data])
    line, shingle = line_shingles(np.frombuffer(b"".join(data), np.uint8), ends - [len(x) for x in data], ends)
    assert set_sizes(line, shingle, len(lines)).tolist() == [len(shingles(x)) for x in lines]
    # The same first bits, and not the same shingle.
    assert set_sizes(np.array([0, 0, 1, 1]), np.array([1 << 40, 1 << 40 | 1, 6, 6], np.uint64), 2).tolist() == [2, 1]
    assert len(set_sizes(np.zeros(0, np.int64), np.zeros(0, np.uint64), 0)) == 0
