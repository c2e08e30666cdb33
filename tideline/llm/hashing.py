"""Hashes of byte and word windows, and content-picked anchors, over whole Arrow batches.

A text is a sequence of units: its bytes, or hashes of its words. Polynomial prefix sums modulo 2^64 over random unit
values give the hash of any window from two of them. Anchors are sliding-window minima (minimizers): the same window of
units picks the same anchor wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
#: Byte values of the two hash families.
BYTE_VALUES = tuple(np.random.default_rng(s).integers(1, 1 << 64, 256, dtype=np.uint64) for s in (101, 202))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


@cache
def _powers(family: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASE[family]
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size + 1, b, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def powers(family: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(family, 1 << max(16, n.bit_length()))


class Prefix:
    """Prefix sums of a sequence of unit values; at() gives the hashes of windows."""

    def __init__(self, values: np.ndarray, family: int = 0):
        self.up, self.down = powers(family, len(values))
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, n: int) -> np.ndarray:
        """Hashes of all windows of n units."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column as one array, and the offsets of its values; nulls are empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of values of together at most ``most`` bytes, or of one value."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (a run of bytes other than ASCII white space), and each value's offset in words."""
    inside = ~_SPACE[data]
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1]
    ends_here = inside.copy()
    ends_here[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts_here[cuts] = inside[cuts]
    ends_here[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(starts_here)
    return starts, np.flatnonzero(ends_here) + 1, np.searchsorted(starts, offsets)


def word_values(data: np.ndarray, offsets: np.ndarray, family: int = 0, lower: bool = False, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for every word of every text, and each text's offset in words. Memory follows the words, not the bytes."""
    values, at, total = [], [np.zeros(1, dtype=np.int64)], 0
    table = BYTE_VALUES[family]

    def hashed(part, local):
        s, e, o = word_spans(part, local)
        v = Prefix(table[_LOWER[part] if lower else part], family).at(s, e) if len(s) else np.zeros(0, dtype=np.uint64)
        return mix(v + (e - s).astype(np.uint64)), o

    for i, j in blocks(offsets, block):
        part, local = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if j == i + 1 and len(part) > 2 * block:
            count = 0
            for a, b in _word_cuts(part, block):
                v, _ = hashed(part[a:b], np.array([0, b - a]))
                values.append(v)
                count += len(v)
            o = np.array([0, count])
        else:
            v, o = hashed(part, local)
            values.append(v)
        at.append(total + o[1:])
        total += int(o[-1])
    return np.concatenate(values) if values else np.zeros(0, dtype=np.uint64), np.concatenate(at)


def _word_cuts(part: np.ndarray, block: int) -> Iterator[tuple[int, int]]:
    """Ranges of a long text that end at white space, of about one block each."""
    a = 0
    while a < len(part):
        b = min(a + block, len(part))
        while b < len(part) and not _SPACE[part[b]]:
            b += 1
        yield a, b
        a = b


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For every window of w (a power of two) hashes, the place of the least one; the last of equals."""
    bits = np.uint64((1 << max(len(h).bit_length(), 1)) - 1)
    v = (h & ~bits) | (bits - np.arange(len(h), dtype=np.uint64))
    step = 1
    while step < w:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    return (bits - (v & bits)).astype(np.int64)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
