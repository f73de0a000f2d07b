"""Vectorised text primitives on whole Arrow batches.

A batch of texts is handled as one byte array with document offsets, so words,
lines, shingles and byte windows cost a few numpy operations for the batch and
no Python work per word.  Substring hashes come from prefix sums of
``table[byte] * BASE**i`` modulo 2**64: the difference of two prefix sums,
divided by ``BASE**start``, depends on the substring alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc



def _return_memory() -> None:
    """Have large arrays mapped and unmapped one by one, so that an idle worker keeps none of them."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which also stays fixed from then on
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # not glibc
        return
    pa.set_memory_pool(pa.system_memory_pool())


_return_memory()

U64 = np.uint64
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); bijective."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


with np.errstate(over="ignore"):
    _BYTE = mix((np.arange(256, dtype=U64) + U64(1)) * U64(0xD6E8FEB86659FD93)) | U64(1)


class _Powers:
    """BASE**i and BASE**-i, grown on demand and kept for the worker's life."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=U64)
        self.down = np.ones(1, dtype=U64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, min(2 * len(self.up), CHUNK_BYTES + 1024))
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, dtype=U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_POWERS = _Powers()


class Hasher:
    """Hashes of substrings of one byte array."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        _POWERS.need(n + 1)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(_BYTE[data] * _POWERS.up[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * _POWERS.down[start]
        return mix(raw + (end - start).astype(U64) * U64(0xA24BAED4963EE407))

    def grams(self, length: int) -> np.ndarray:
        """Hash of every window of ``length`` bytes, by start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, dtype=U64)
        return mix((self.sums[length:] - self.sums[:n]) * _POWERS.down[:n])


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Texts as large_binary without nulls (null becomes empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    return pc.fill_null(column, b"") if column.null_count else column


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) in slices of about ``limit`` bytes; a longer text is a slice of its own."""
    column = binary(column)
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    store = column.buffers()[2]
    data = np.frombuffer(store, dtype=np.uint8) if store is not None and store.size else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (one entry more at the end)."""
    n = len(data)
    if n == 0:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    inside = ~WHITE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    cut[0] = cut[n] = True
    before = np.ones(n, dtype=bool)
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | cut[:n]))
    after = np.ones(n, dtype=bool)
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each element the index of the text it belongs to, from the bounds of the texts' elements."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of every window of ``width`` words inside one text."""
    text = owners(bounds)
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=U64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    first = np.flatnonzero(text[:n] == text[width - 1 :])
    total = np.zeros(n, dtype=U64)
    for j in range(width):
        total += hashes[j : j + n] * U64((0x9FB21C651E98DF25 * (2 * j + 1) + 2 * j) & _MASK | 1)
    return mix(total[first]), text[:n][first], first


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by block prefix and suffix minima."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=values.dtype)
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
