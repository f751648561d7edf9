"""Vectorised word and window hashing over the raw bytes of Arrow text columns.

Texts are never turned into Python strings here: a batch is one byte buffer with
offsets, words are found with a 256-entry class table, and polynomial prefix sums
(modulo 2**64) give the hash of any byte range or word range in constant time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes outside words when only digits, ASCII letters and non-ASCII bytes make words.
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
SLICE_BYTES = 1 << 19
WINDOW_BASE = 0x2545F4914F6CDD1D


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a polynomial hash depends on all of it."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


@lru_cache(maxsize=8)
def byte_table(seed: int, lower: bool) -> np.ndarray:
    """A random odd value for each byte value; with lower, A-Z share those of a-z."""
    t = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
    return t[LOWER] if lower else t


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n; kept for the largest n so far, up to half a million."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(n * 5 // 4, 1 << 16) if n < 1 << 19 else n
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        got = np.cumprod(up), np.cumprod(down)
        if size <= 5 << 17:
            _POWERS[base] = got
    return got[0][:n], got[1][:n]


class RangeHash:
    """Hashes of ranges [start, end) of a sequence of 64-bit values, through prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, self.down = powers(base, n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, width: int) -> np.ndarray:
        """Hashes of all ranges of `width` values."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.down[:n])


def give_back() -> None:
    """Hands freed memory back to the system: workers are used again by later stages, which would find it gone."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not on every C library
        pass


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Consecutive parts of a batch of about `most` bytes of text, one row at least."""
    _, offsets = text_buffer(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """The words of a batch of texts.

    start, end: byte ranges in data; first: index of each row's first word, with the
    total at the end; hash: 64-bit hash of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, outside: bytes, lower: bool, seed: int = 11):
        self.data, self.offsets = data, offsets
        inside = np.ones(256, dtype=bool)
        inside[list(outside)] = False
        m = inside[data]
        before = np.zeros(len(m), dtype=bool)
        before[1:] = m[:-1]
        heads = offsets[:-1][offsets[:-1] < len(m)]
        before[heads] = False
        after = np.zeros(len(m), dtype=bool)
        after[:-1] = m[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        after[tails] = False
        self.start = np.flatnonzero(m & ~before)
        self.end = np.flatnonzero(m & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = RangeHash(byte_table(seed, lower)[data], 0x5851F42D4C957F2D).of(self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def left(self) -> np.ndarray:
        """For each word, how many words of its row start at it or later."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self))

    def windows(self, width: int, base: int = WINDOW_BASE) -> tuple[np.ndarray, np.ndarray]:
        """Start words and hashes of all windows of `width` words within a row."""
        at = np.flatnonzero(self.left() >= width)
        return at, RangeHash(self.hash, base).of(at, at + width)

    def text(self, word: int, width: int = 1) -> list[bytes]:
        return [self.data[self.start[i] : self.end[i]].tobytes() for i in range(word, word + width)]


def of_column(column: pa.Array, outside: bytes, lower: bool, seed: int = 11) -> Words:
    return Words(*text_buffer(column), outside, lower, seed)


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... (n of them) of all ranges, one after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)


def blocks(lengths: np.ndarray, most: int = 1 << 18) -> Iterator[slice]:
    """Parts of ranges of these lengths with about `most` bytes each."""
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def equal_ranges(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether x[a : a + n] and y[b : b + n] are equal byte for byte, for ranges that aren't empty."""
    out = np.empty(len(a), dtype=bool)
    for p in blocks(n):
        same = x[spread(a[p], n[p])] == y[spread(b[p], n[p])]
        out[p] = np.logical_and.reduceat(same, np.cumsum(n[p]) - n[p])
    return out


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n positions lie in a window of `width` that begins at one of starts."""
    if not len(starts):
        return np.zeros(n, dtype=bool)
    d = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(d[:n]) > 0


def runs(mask: np.ndarray, first: np.ndarray) -> list[list[list[int]]]:
    """For each row (positions first[k] to first[k + 1]) its maximal true runs as [start, end) from the row's start."""
    n = len(mask)
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    before[first[:-1][first[:-1] < n]] = False
    after[first[1:][first[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    own = np.searchsorted(first, starts, "right") - 1
    out: list[list[list[int]]] = [[] for _ in range(len(first) - 1)]
    for d, a, b in zip(own.tolist(), (starts - first[own]).tolist(), (ends - first[own]).tolist(), strict=True):
        out[d].append([a, b])
    return out


def planes(values: np.ndarray, size: int = 8) -> bytes:
    """Sorted values of `size` bytes, byte plane by byte plane, most significant last: long runs for the shuffle's codec."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def from_planes(blob: bytes, size: int = 8) -> np.ndarray:
    out = np.zeros((len(blob) // size, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(blob, np.uint8).reshape(size, -1).T
    return out.view("<u8").ravel()
