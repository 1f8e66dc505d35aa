"""Vectorised text primitives shared by the operators that run in Arrow batches.

Texts arrive as one UTF-8 buffer with offsets, so words, n-grams and shingles of a
whole batch are found with a handful of numpy passes instead of a Python loop per word.
All white space of the word definition ``[^\\x20\\x09-\\x0D]+`` is ASCII, so the byte
view is exact.  Hashes are 64 bit and fixed (no per-process seed), so that a task that
is run again after a lost executor gives the same rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# buffers go back to the system when they are freed: a worker lives on between stages
pa.set_memory_pool(pa.system_memory_pool())


def release() -> None:
    """Hand freed memory back to the system; called when a scan ends."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up, self.down = np.full(size, _P, U64), np.full(size, _P_INV, U64)
                self.up[0] = self.down[0] = 1
                self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs lo..hi of whole rows with at most ``most`` units each; a larger row is a run of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that stay within a row: starts, ends and, for each row, where its runs begin."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    edge = offsets[:-1]
    edge = edge[edge < n]
    first[edge] = mask[edge]
    starts = np.flatnonzero(first)
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    tail = offsets[1:] - 1
    tail = tail[tail >= 0]
    last[tail] = mask[tail]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(~_IS_SPACE[data], offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial over random byte codes, then a finaliser."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _POWERS.get(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE_CODES[data] * up[:-1], out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


_ORDERED = mix64(np.arange(1, 65, dtype=U64)) | U64(1)


def ngram_hashes(hashes: np.ndarray, bounds: np.ndarray, n: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the words of each row, and the rows' bounds among them.

    whole: a row with fewer than n words, but at least one, gives its whole sequence as one n-gram.
    """
    count = np.diff(bounds)
    per_row = np.maximum(count - n + 1, 0)
    if whole:
        per_row = np.where((count > 0) & (count < n), 1, per_row)
    out_bounds = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros(int(out_bounds[-1]), U64)
    with np.errstate(over="ignore"):
        if len(hashes) >= n:
            at = np.zeros(len(hashes) - n + 1, U64)
            for k in range(n):
                at += hashes[k : len(hashes) - n + 1 + k] * _ORDERED[k]
            at = mix64(at + U64(n))
            full = np.zeros(len(hashes), bool)
            rows = np.flatnonzero(count >= n)
            delta = np.zeros(len(hashes) + 1, np.int32)
            np.add.at(delta, bounds[rows], 1)
            np.add.at(delta, bounds[rows + 1] - n + 1, -1)
            full = np.cumsum(delta[:-1]) > 0
            target = np.ones(len(out), bool)
            short = np.flatnonzero((count > 0) & (count < n)) if whole else []
            target[out_bounds[short]] = False
            out[target] = at[np.flatnonzero(full)]
        if whole:
            for r in np.flatnonzero((count > 0) & (count < n)):
                part = hashes[bounds[r] : bounds[r + 1]]
                total = int((part * _ORDERED[: len(part)]).sum(dtype=U64)) + len(part)
                out[out_bounds[r]] = mix64(np.array([total & (1 << 64) - 1], U64))[0]
    return out, out_bounds


def distinct_by_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their bounds."""
    parts, sizes = [], np.zeros(len(bounds) - 1, np.int64)
    for r in range(len(bounds) - 1):
        if bounds[r + 1] > bounds[r]:
            own = np.sort(values[bounds[r] : bounds[r + 1]])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            parts.append(own)
            sizes[r] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, values.dtype)), np.concatenate([[0], np.cumsum(sizes)])


def shingle_sets(column: pa.Array, n: int, chunk: int = 512 << 10) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: lo, hi, the rows' sorted sets of n-word shingles (64-bit), their bounds."""
    data, offsets = utf8(column)
    for lo, hi in blocks(offsets, chunk):
        own, at = ASCII_LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, bounds = words(own, at)
        grams, bounds = ngram_hashes(span_hashes(own, starts, ends), bounds, n, whole=True)
        yield lo, hi, *distinct_by_row(grams, bounds)
