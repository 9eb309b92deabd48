"""Hashes of all words, shingles and byte windows of many texts at once, in numpy.

The hash of a segment is a polynomial modulo 2**64 whose prefix sums give any segment in two lookups;
a finalizer mixes its bits. All hashes depend on the contents alone, not on the place in the batch.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 ... n of the base and of its inverse."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


class Segments:
    """Hashes of any segments of a sequence of integers."""

    def __init__(self, values: np.ndarray):
        self.power, self.inverse = _powers(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.power[: len(values)], out=self.sums[1:], dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, size: int) -> np.ndarray:
        """The hash of every window of `size` values, across any bounds."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def lower(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[raw]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than white space within a text, and the first word of each text (n + 1)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = True, space[1:]
    start = np.flatnonzero(~space & (before | edge[:-1]))
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Segments(raw).of(start, end)


def within(first: np.ndarray, size: int) -> np.ndarray:
    """Which windows of `size` items lie within one text, given the first item of each text (n + 1)."""
    n = int(first[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.zeros(n + 1, np.int32)
    lo, hi = first[:-1], first[1:] - size + 1
    real = hi > lo
    np.add.at(ok, lo[real], 1)
    np.add.at(ok, hi[real], -1)
    return np.cumsum(ok[:-1]) > 0


def sliding_min(h: np.ndarray, size: int) -> np.ndarray:
    """The least of every `size` values in a row."""
    n = len(h) - size + 1
    if n <= 0:
        return h[:0]
    out, have = h, 1
    while 2 * have <= size:  # doubles the reach
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < size:
        out = np.minimum(out[:n], out[size - have :][:n])
    return out[:n]
