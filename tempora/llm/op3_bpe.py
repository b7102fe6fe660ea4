"""Byte-level BPE encoding and decoding over Arrow batches.

The vocabulary comes from a file of ranks (base64 token, rank). Byte-level BPE writes each byte as
one printable character: bytes that print stand for themselves, the others take the characters
from U+0100 in order. The merge list is rebuilt from the ranks (a token's last merge joins the two
parts that BPE restricted to lower ranks ends with), and the ``tokenizers`` library then encodes each
match of the pattern separately. Decoding looks each id up in the byte table, so characters that
are split over tokens come back when their bytes meet; ``decode_text`` joins bytes first and
replaces only what is no UTF-8 in the end.

White space after a character that is none always begins a match of the usual pattern, and so does ASCII
punctuation after an ASCII letter, so texts fall into pieces there whose ids do not depend on what is around; a worker encodes each different piece once. With another
pattern the piece is the whole text.

Edge cases. A null text is encoded as an empty one (no ids). Repeated rows are encoded each on its own row; an empty
table gives an empty result; other columns pass through ``encode`` untouched, and a clash with its
output column raises.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textkern as K

#: Pieces whose ids a worker remembers; beyond them it starts anew.
MAX_KNOWN = 150_000
#: Pieces that the library gets at once.
CALL_PIECES = 8_192


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(other)) for b in range(256)]


class Codec:
    """One vocabulary: the library's encoder, and the bytes of each id."""

    def __init__(self, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        char = byte_characters()
        named = {token: "".join(char[b] for b in token) for token in ranks}
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                left, right = self._last_merge(token, rank, ranks)
                merges.append((named[left], named[right]))
        model = models.BPE(vocab={named[t]: r for t, r in ranks.items()}, merges=merges, cache_capacity=0)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cuts = pattern == default_pattern()
        self._forget()
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self._bytes = pa.array(self.token_bytes, pa.large_binary())
        self._width = np.array([len(t) for t in self.token_bytes])
        self._decimal = pa.array([f" {i}".encode() for i in range(len(self.token_bytes))], pa.large_binary())

    @staticmethod
    def _last_merge(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: (r if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank else rank, i))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts[0], parts[1]

    def _forget(self) -> None:
        self._slots: dict[int, int] = {}
        self._begin, self._flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(texts), CALL_PIECES):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + CALL_PIECES], add_special_tokens=False)]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """All ids of a slice of texts, where each text's begin and end, and the bytes of each id.

        Each different piece is encoded by the library once and remembered by its hash; that the ids'
        bytes are the texts' bytes is then checked, and a slice where they are not (two pieces of one hash) is encoded as
        it stands.
        """
        starts, ends, first = self._pieces(data, offsets)
        hashes, at, of = np.unique(K.RangeHash(data)(starts, ends), return_index=True, return_inverse=True)
        if len(self._slots) + len(hashes) > MAX_KNOWN:
            self._forget()
        known = self._slots
        new = [i for i, h in enumerate(hashes.tolist()) if h not in known]
        lists = self._library([data[a:b].tobytes().decode() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
        known.update(zip(hashes[new].tolist(), range(len(known), len(known) + len(new)), strict=True))
        self._begin = np.append(self._begin, self._begin[-1] + np.cumsum([len(x) for x in lists], dtype=np.int64))
        self._flat = np.append(self._flat, np.fromiter(chain.from_iterable(lists), np.int32))
        slot = np.fromiter((known[h] for h in hashes.tolist()), np.int64, len(hashes))[of]
        begin, many = self._begin[slot], self._begin[slot + 1] - self._begin[slot]
        total = np.concatenate([[0], np.cumsum(many)])
        ids = self._flat[np.repeat(begin - total[:-1], many) + np.arange(total[-1])]
        bounds, body = total[first], self.decode(ids)
        if not np.array_equal(np.frombuffer(body.buffers()[2] or b"", np.uint8)[: len(data)], data) or len(data) != self._width[ids].sum():
            lists = self._library([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            ids = np.array([i for x in lists for i in x], np.int32)
            bounds, body = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), self.decode(ids)
        return ids, bounds, body

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of pieces between sure ends of matches, and each text's first piece."""
        begin = np.zeros(len(data), bool)
        begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        if self.cuts:
            solid = (data > 0x20) & (data < 0x7F)
            solid[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
            begin[1:] |= ~K.NONSPACE[data[1:]] & solid[:-1]
            letter = (data | 0x20) - np.uint8(0x61) < 26
            begin[1:] |= letter[:-1] & ~letter[1:] & (data[1:] > 0x20) & (data[1:] < 0x7F) & ((data[1:] < 0x30) | (data[1:] > 0x39))
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)

    def encode_with_offsets(self, text: str | None) -> list[tuple[int, int, int]]:
        """(id, first character, last character + 1) of each token; tokens of a split character share it."""
        e = self.tokenizer.encode(text or "", add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    def decode(self, ids: np.ndarray) -> pa.Array:
        """The bytes of each id, one after the other in one buffer."""
        return pc.take(self._bytes, pa.array(ids))

    def decode_text(self, ids: np.ndarray) -> str:
        return b"".join(self.token_bytes[i] for i in ids).decode("utf-8", errors="replace")

    def joined_sha256(self, parts: pa.Array, bounds: np.ndarray, skip: int = 0) -> list[str]:
        """The hash of each text's parts joined, without the first ``skip`` bytes."""
        where = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
        body = memoryview(parts.buffers()[2] or b"")
        return [hashlib.sha256(body[min(where[a] + skip, where[b]) : where[b]]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def decimal_sha256(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        return self.joined_sha256(pc.take(self._decimal, pa.array(ids)), bounds, skip=1)


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    """A worker process builds each vocabulary once."""
    made = Codec(ranks_path, pattern)
    K.release()
    return made


def encode(docs: DataFrame, text: str = "text", into: str = "ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with the ids of its texts in an array column."""
    path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    if into in docs.columns:
        raise ValueError(f"the table already has a column {into}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            column = K.text_column(batch, text)
            for a, b, data, offsets in K.slices(column):
                ids, bounds, _ = c.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, lists], names=[*batch.schema.names, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{into}` array<int>")


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, of encoding and then decoding the ids."""
    path, pattern = ranks_path or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            column = K.text_column(batch, "text")
            for a, b, data, offsets in K.slices(column):
                ids, bounds, body = c.encode(data, offsets)
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(c.decimal_sha256(ids, bounds)), pa.array(c.joined_sha256(body, bounds))],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
