"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing names."""

import random
import zlib

SYLLABLES = "an the of tion er ing re st ou wh ha è ü ñ ea in".split()


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts(seed=0, n=40):
    rng = random.Random(seed)
    out = [None, "", " \n\t ", "x", "aaaa " * 200, "a" * 3000, "😀é\n\n😀é\r\n# | <b> $5", "one two three one two three one two three"]
    while len(out) < n:
        kind = rng.random()
        base = "\n".join(words(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 8)))
        if kind < 0.25 and len(out) > 12:
            base = rng.choice([t for t in out if t])
        elif kind < 0.5 and len(out) > 12:
            w = rng.choice([t for t in out if t]).split(" ")
            w[rng.randrange(len(w))] = "changed"
            base = " ".join(w)
        out.append(base)
    return out


def documents(spark, rows=None, seed=0, extra=True):
    rows = rows if rows is not None else list(enumerate(texts(seed)))
    full = [(i, t, "en", None if i and i % 5 == 0 else f"src{(i or 0) % 3}", None if t is None else len(t)) + (((i or 0) * 2, "n") if extra else ()) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", score long, kept string" if extra else "")
    return spark.createDataFrame(full, schema)


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4
