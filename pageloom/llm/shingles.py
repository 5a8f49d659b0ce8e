"""Hashes of words and shingles of whole Arrow columns, in numpy.

A word's hash is the difference of two running sums of byte * BASE^position modulo 2^64, divided by BASE^start: all words
of many texts cost a few passes over their bytes. Hashes are mixed, so equal words have equal hashes wherever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once, so that arrays of numbers stay small; a longer text is a slice of its own.
SLICE = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_table = np.random.default_rng(20_260_101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_raised = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    if len(_raised[base]) < n:
        steps = np.full(max(n, SLICE + 1), base, dtype=np.uint64)
        steps[0] = 1
        _raised[base] = np.cumprod(steps, dtype=np.uint64)
    return _raised[base][:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets in them) of neighbouring rows of about SLICE bytes."""
    data, offsets = column_bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text in order, A-Z lowered, and where each text's begin (one more than texts)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_table[lower] * _powers(_BASE, n), out=sums[1:])
    return mix((sums[stops] - sums[starts]) * _powers(_INVERSE, n)[starts]), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of a shorter text its words as one shingle."""
    weights = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    for _, _, data, offsets in slices(column):
        words, begins = word_hashes(data, offsets)
        sums = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for j in range(n):
            sums += words[j : j + len(sums)] * weights[j]
        sums = mix(sums)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(sums[a : b - n + 1])
            elif b > a:
                yield mix(np.sum(words[a:b] * weights[: b - a], keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
