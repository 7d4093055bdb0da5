"""Numpy work on the bytes of Arrow text columns, inside tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the polynomial hash modulo 2**64, and the seed of the byte values.
BASE = 0x9E3779B97F4A7C15
SEED = 20_231
#: Bytes of text worked on at once (a longer document is worked on alone).
SLICE_BYTES = 1 << 20


def upper_to_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def byte_class(is_in) -> np.ndarray:
    """Boolean table over byte values."""
    return np.array([bool(is_in(b)) for b in range(256)])


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of word bytes; words never cross rows."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = in_word[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | fresh[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | fresh[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def _kept() -> dict:
    """Tables that live as long as the worker process, which outlives the task functions sent to it."""
    return sys.modules.setdefault("cohortlens_tables", types.ModuleType("cohortlens_tables")).__dict__


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**n modulo 2**64, kept for slices of usual length."""
    size = max(SLICE_BYTES, n) + 1
    got = _kept().get((base, size))
    if got is None:
        got = np.empty(size, np.uint64)
        got[0], m = 1, 1
        while m < size:
            k = min(m, size - m)
            got[m:m + k] = got[:k] * np.uint64(pow(base, m, 1 << 64))
            m += k
        if size == SLICE_BYTES + 1:
            _kept()[base, size] = got
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class RangeHash:
    """Polynomial hashes of any byte ranges of a text, from prefix sums: equal ranges have equal hashes."""

    def __init__(self, data: np.ndarray, table: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * _powers(BASE, n)[:n], out=self.prefix[1:])
        self.inverse = _powers(pow(BASE, -1, 1 << 64), n)

    def __call__(self, start, end) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def every(self, size: int) -> np.ndarray:
        """Unmixed hashes of all ranges of one size."""
        k = len(self.prefix) - size
        return (self.prefix[size:] - self.prefix[:k]) * self.inverse[:k]


def byte_values(fold_case: bool = False) -> np.ndarray:
    """Random odd values of bytes, fixed by a seed; A-Z count as a-z if asked."""
    table = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    return table[upper_to_lower()] if fold_case else table


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    if offsets[-1] >= 2**31:
        raise ValueError("a slice holds too many values for one batch")
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
