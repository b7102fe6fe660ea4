"""Vectorised kernels over the bytes of many texts at once.

An Arrow string column already is one byte buffer plus offsets. The kernels work on that
buffer in slices of a few megabytes: character classes come from 256-entry tables, word and
window hashes from one prefix polynomial, and per-document figures from segment sums. No
Python object is made per word, and every text is read whole: a slice holds whole texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):  # another C library
    _LIBC = None


def release() -> None:
    """Give freed memory back to the system: workers are kept between tasks, and several live beside an executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


#: Bytes of text that one kernel call works on; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NONSPACE = ~_SPACE
#: Letters, digits and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: The first byte of each character.
LEAD = np.ones(256, bool)
LEAD[0x80:0xC0] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.Generator(np.random.Philox(20240229))
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER_VALUES = BYTE_VALUES[LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        step = np.full(size, base, np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 constants)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class RangeHash:
    """Hashes of any byte ranges of a buffer, from one prefix polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES):
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * _power_table(_BASE, len(data)), out=self._sums[1:])
        self._inverse = _power_table(_INVERSE, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """The hash of every window of that width."""
        n = len(self._sums) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sums[width:] - self._sums[:n]) * self._inverse[:n] + np.uint64(width))


#: Bytes of text whose columns of 64-bit numbers stay in a processor's cache.
CACHE_BYTES = 1 << 17


def stretches(starts: np.ndarray, ends: np.ndarray, limit: int = CACHE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of runs of ascending ranges that reach over no more than so many bytes; one longer range is a run of its own."""
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + limit, "right")))
        yield a, b
        a = b


def hashes_in_order(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes that ``RangeHash`` gives, of ascending ranges that do not overlap and are not empty."""
    out = np.zeros(len(starts), np.uint64)
    for a, b in stretches(starts, ends):
        base, stop = starts[a], ends[b - 1]
        # A last term of 0 is the end of the last range.
        terms = np.zeros(stop - base + 1, np.uint64)
        np.multiply(BYTE_VALUES[data[base:stop]], _power_table(_BASE, stop - base), out=terms[:-1])
        edges = np.stack([starts[a:b] - base, ends[a:b] - base], axis=1).ravel()
        sums = np.add.reduceat(terms, edges)[::2]
        out[a:b] = mix(sums * _power_table(_INVERSE, stop - base + 1)[starts[a:b] - base] + (ends[a:b] - starts[a:b]).astype(np.uint64))
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay within one text, and each text's first run."""
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin = edge[:n].copy()
    begin[0] = True
    begin[inner] = True
    starts = np.flatnonzero(begin & inside)
    stop = edge.copy()
    stop[n] = True
    stop[inner] = True
    ends = np.flatnonzero(stop[1:] & inside) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def owners(first: np.ndarray) -> np.ndarray:
    """Of each run, the text that it lies in."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of slices of whole texts; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    release()


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    return column


def order_within(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The order by (group, value); groups of a slice mostly fit 16 bits, which sort by radix."""
    if len(group) and int(group.max()) < 1 << 16:
        by_value = np.argsort(values)
        return by_value[np.argsort(group[by_value].astype(np.uint16), kind="stable")]
    return np.lexsort((values, group))
