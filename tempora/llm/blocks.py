"""Documents packed into blocks, and questions that all blocks ask about hashed keys.

A block holds some megabytes of whole texts in one compressed row. Blocks are made where the table is
read, dealt by number once and kept in the shared folder, so later passes read them in place.

``ask`` lets every block put a sorted list of 48-bit keys (with columns of values) to buckets by key
range, and gives each block the answers: some bits for each of its keys. A block sends a key once,
however many of its texts have it, so a key in a third of all documents reaches a bucket once per
block; an answer of only zeros is not sent. Keys travel as differences in byte planes, compressed,
three to four bytes each.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkern as K
from .workdir import cut, cut_by

#: Bytes of text in a block; one longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of text whose keys one bucket is to answer for.
BUCKET_TEXT_BYTES = 8 << 20
#: Stands for a missing id, which comes before all others.
NO_ID = -(1 << 63)


def planes(column: np.ndarray) -> tuple[int, bytes]:
    column = np.ascontiguousarray(column, np.uint64)
    width = (int(column.max()).bit_length() + 7) // 8 if len(column) else 0
    return width, column.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def encode_columns(*columns: np.ndarray) -> bytes:
    """Unsigned columns of one length; the first is sorted and kept as differences."""
    first = columns[0].astype(np.uint64)
    parts = [planes(np.diff(first, prepend=np.uint64(0))), *(planes(c) for c in columns[1:])]
    head = struct.pack(f"<IB{len(parts)}B", len(first), len(parts), *(w for w, _ in parts))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(p for _, p in parts))


def decode_columns(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n, k = struct.unpack_from("<IB", raw)
    widths = struct.unpack_from(f"<{k}B", raw, 5)
    at, out = 5 + k, []
    for w in widths:
        column = np.zeros((n, 8), np.uint8)
        if w:
            column[:, :w] = np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T
        at += n * w
        out.append(column.reshape(-1).view(np.uint64))
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def encode_keys(keys: np.ndarray) -> bytes:
    """A table of 48-bit keys, six bytes each."""
    return np.ascontiguousarray(keys, np.uint64).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def decode_keys(body: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(body, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.reshape(-1).view(np.uint64).reshape(-1, width)


class Block:
    """The texts of one block. Its number is that of its first row: ``number`` + a row's place in the block is the row's own number."""

    def __init__(self, number: int, ids: bytes, offsets: bytes, body: bytes, carry: bytes | None = None, extra: bytes | None = None):
        self.number, self._body, self._carry, self._extra = number, body, carry, extra
        self.ids = np.frombuffer(ids, np.int64)
        self.offsets = np.frombuffer(offsets, np.int64)

    @functools.cached_property
    def data(self) -> np.ndarray:
        """The bytes of all texts, unpacked where they are asked for."""
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self._body) if len(self._body) else b"", np.uint8)

    def index(self) -> list[np.ndarray]:
        """The columns that ``pack`` was told to make of the texts."""
        return decode_columns(self._extra)

    @classmethod
    def of_texts(cls, block: Block, nth: np.ndarray) -> Block:
        """A block of some of another's texts, in the order given."""
        out = cls.__new__(cls)
        out.number, out._carry, out.ids = block.number, None, block.ids[nth]
        out.offsets = np.concatenate([[0], np.cumsum(block.offsets[nth + 1] - block.offsets[nth])]).astype(np.int64)
        out.data = np.concatenate([block.data[block.offsets[i] : block.offsets[i + 1]] for i in nth]) if len(nth) else block.data[:0]
        return out

    def slices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, bytes, offsets) of slices of whole texts."""
        row, n = 0, len(self.ids)
        while row < n:
            end = max(row + 1, int(np.searchsorted(self.offsets, self.offsets[row] + K.SLICE_BYTES, "right")) - 1)
            end = min(end, n)
            yield row, self.data[self.offsets[row] : self.offsets[end]], self.offsets[row : end + 1] - self.offsets[row]
            row = end

    def id_column(self, name_type: pa.DataType) -> pa.Array:
        return pa.array(self.ids, mask=self.ids == NO_ID).cast(name_type)

    def rows(self, keep: np.ndarray, texts: pa.Array | None = None) -> pa.RecordBatch:
        """The packed rows, all columns, where ``keep``; with other texts, if given."""
        raw = zstandard.ZstdDecompressor().decompress(self._carry)
        table = pa.ipc.open_stream(raw).read_all().combine_chunks()
        if texts is None:
            texts = pa.Array.from_buffers(pa.binary(), len(self.ids), [None, pa.py_buffer(self.offsets.astype(np.int32)), pa.py_buffer(self.data)]).cast(pa.string())
            texts = pc.if_else(table.column("text"), texts, pa.scalar(None, pa.string()))
        at = table.schema.get_field_index("text")
        table = table.set_column(at, "text", texts).filter(pa.array(keep))
        return pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks else pa.array([], c.type) for c in table.columns], schema=table.schema)


FIELDS = "block long, ids binary, offsets binary, body binary, carry binary, extra binary, n_bytes long"
#: Rows that one task can number.
TASK_ROWS = 33


def fields_of(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)


#: Columns made of a slice's bytes and offsets; the first two are its texts and ascending places of its bytes.
Index = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


def id_type(docs: DataFrame) -> pa.DataType:
    """The type of the ids; blocks take whole numbers only."""
    kind = docs.schema["doc_id"].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise ValueError(f"doc_id must be a whole number, not {kind}")
    return {"byte": pa.int8(), "short": pa.int16(), "integer": pa.int32(), "long": pa.int64()}[kind]


def pack(docs: DataFrame, block_bytes: int | None = None, whole_rows: bool = False, index: Index | None = None, level: int = 3) -> DataFrame:
    """(block, ids, offsets, body, carry, extra, n_bytes), dealt by block and kept in the shared folder.

    ``whole_rows``: all columns travel along, for ``Block.rows``. ``index``: what it makes of the texts is kept, for ``Block.index``. ``level``: of compression."""
    block_bytes = block_bytes or BLOCK_BYTES
    id_type(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << TASK_ROWS
        ids, lengths, parts, others, made, rows, size = [], [], [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            nonlocal number, ids, lengths, parts, others, made, rows, size
            carry = None
            if whole_rows:
                sink = pa.BufferOutputStream()
                table = pa.Table.from_batches(others)
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                carry = compressor.compress(sink.getvalue())
            extra = encode_columns(*(np.concatenate(c) for c in zip(*made, strict=True))) if made else None
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
            values = [number, np.concatenate(ids).tobytes(), offsets.tobytes(), compressor.compress(b"".join(parts)), carry, extra, size]
            kinds = [pa.int64(), *[pa.binary()] * 5, pa.int64()]
            out = pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["block", "ids", "offsets", "body", "carry", "extra", "n_bytes"])
            number, ids, lengths, parts, others, made, rows, size = number + rows, [], [], [], [], [], 0, 0
            return out

        for batch in batches:
            own = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(NO_ID).to_numpy()
            at = batch.schema.get_field_index("text")
            there = batch.set_column(at, "text", batch.column(at).is_valid())  # only whether there was a text
            for a, b, data, offsets in K.slices(K.text_column(batch, "text"), block_bytes // 4):
                if index:
                    text, place, *more = index(data, offsets)
                    made.append((place + size, text + rows, *more))
                ids.append(own[a:b])
                lengths.append(np.diff(offsets))
                parts.append(data.tobytes())
                if whole_rows:
                    others.append(there.slice(a, b - a))
                rows += b - a
                size += len(data)
                if size >= block_bytes:
                    yield row()
        if ids:
            yield row()

    packed = (docs if whole_rows else docs.select("doc_id", "text")).mapInArrow(run, FIELDS)
    return cut_by(packed, "block")


def total_bytes(blocks: DataFrame) -> int:
    return blocks.select(F.sum("n_bytes")).first()[0] or 0


def bucket_count(size: int, keys_per_byte: float = 1 / 6) -> int:
    """Buckets for a corpus of that many bytes of text, with so many keys a byte."""
    return max(1, int(size * keys_per_byte * 6 // BUCKET_TEXT_BYTES) + 1)


def opened(batches: Iterator[pa.RecordBatch], answers: int) -> Iterator[tuple[Block, list[dict[int, bytes]]]]:
    """The blocks of a task, each with the answers to the first questions."""
    for batch in batches:
        columns = {name: batch.column(batch.schema.get_field_index(name)) for name in batch.schema.names}
        for i in range(batch.num_rows):
            got = [{x["bucket"]: x["bits"] for x in columns[f"answer{k}"][i].as_py() or ()} for k in range(answers)]
            yield Block(*(columns[c][i].as_py() for c in ("block", "ids", "offsets", "body", "carry", "extra"))), got
    K.release()


Keys = tuple[np.ndarray, ...]


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in a sorted list of 48-bit keys."""
    edge = (np.arange(1, buckets, dtype=object) * (1 << 48) // buckets).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edge), [len(keys)]])


def bits_of(keys: np.ndarray, answer: dict[int, bytes], buckets: int, width: int) -> list[np.ndarray]:
    """The answered bits of each key, as ``width`` boolean columns."""
    out = [np.zeros(len(keys), bool) for _ in range(width)]
    at = bounds(keys, buckets)
    for bucket, body in answer.items():
        n = at[bucket + 1] - at[bucket]
        raw = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)).reshape(width, -1)[:, :n]
        for k in range(width):
            out[k][at[bucket] : at[bucket + 1]] = raw[k]
    return out


def bytes_of(keys: np.ndarray, answer: dict[int, bytes], buckets: int) -> np.ndarray:
    """The answered byte of each key, as a signed number."""
    out = np.zeros(len(keys), np.int8)
    at = bounds(keys, buckets)
    for bucket, body in answer.items():
        out[at[bucket] : at[bucket + 1]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.int8)
    return out


def ask(blocks: DataFrame, question: int, buckets: int, keys: Callable[[Block, list[dict[int, bytes]]], Keys], answer: Callable[..., tuple[np.ndarray, ...]], opener: Callable = opened, once: bool = False) -> DataFrame:
    """``blocks`` with a column of answers. ``opener`` reads its rows (blocks by default). ``keys`` gives a block's sorted 48-bit keys and columns of
    values; ``answer`` gets those of all blocks in a bucket, and gives columns of bits (read by ``bits_of``) or one of signed bytes (``bytes_of``).
    ``once``: the result is read once only, so the answers are not kept."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, got in opener(batches, question):
            columns = keys(block, got)
            at = bounds(columns[0], buckets)
            where, bodies = [], []
            for b in range(buckets):
                if at[b] < at[b + 1]:
                    where.append(b)
                    bodies.append(encode_columns(*(c[at[b] : at[b + 1]] for c in columns)))
            yield pa.record_batch([pa.array(where, pa.int32()), pa.array([block.number] * len(where), pa.int64()), pa.array(bodies, pa.binary())], ["bucket", "block", "body"])

    def reply(key: tuple, table: pa.Table) -> pa.Table:
        got = [decode_columns(x.as_py()) for x in table.column("body")]
        cuts = np.concatenate([[0], np.cumsum([len(g[0]) for g in got])])
        bits = answer(*(np.concatenate(c) for c in zip(*got, strict=True)))
        numbers, bodies = [], []
        for number, a, b in zip(table.column("block").to_pylist(), cuts[:-1], cuts[1:], strict=True):
            own = [c[a:b] for c in bits]
            if any(c.any() for c in own):
                numbers.append(number)
                bodies.append(zstandard.ZstdCompressor(level=1).compress(b"".join((np.packbits(c) if c.dtype == bool else c).tobytes() for c in own)))
        del got, bits
        K.release()
        return pa.table([pa.array(numbers, pa.int64()), pa.array([key[0].as_py()] * len(numbers), pa.int32()), pa.array(bodies, pa.binary())], ["block", "bucket", "bits"])

    sent = blocks.mapInArrow(send, "bucket int, block long, body binary")
    answers = sent.groupBy("bucket").applyInArrow(reply, "block long, bucket int, bits binary")
    each = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"answer{question}"))
    each = each if once else cut(each)
    return blocks.join(each.hint("merge"), "block", "left")


def group_starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where groups of equal rows begin."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def totals(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each key, its counts over all blocks."""
    order = np.argsort(key)
    starts = group_starts(key[order])
    total = np.zeros(len(key), np.uint64)
    if len(key):
        total[order] = np.repeat(np.add.reduceat(count[order], starts), np.diff(np.append(starts, len(key))))
    return total


def shared_answer(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each key: is it in two texts or more."""
    return (totals(key, count) > 1,)


#: Bits of a frequency class.
CLASS_BITS = 4


def class_answer(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each key, the class of its count: 0 for one text, then one for each doubling, 15 for all above."""
    classes = np.minimum(np.ceil(np.log2(np.maximum(totals(key, count), 1).astype(float))), (1 << CLASS_BITS) - 1).astype(np.int64)
    return tuple((classes >> k & 1).astype(bool) for k in range(CLASS_BITS))


def counted(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and in how many texts each is."""
    order = np.lexsort((text, keys))
    k, t = keys[order], text[order]
    first = group_starts(k, t)
    k = k[first]
    starts = group_starts(k)
    return k[starts], np.diff(np.append(starts, len(k))).astype(np.uint64)


def id_rank(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers in the same order."""
    return ids.view(np.uint64) ^ np.uint64(1 << 63)
