"""Monotone integer sequences in Elias-Fano form, read by vectors of positions or values.

A value's low bits are stored as they are; its high part h becomes a one at place h + position of a bit vector.  Place of
the k-th one gives access by position, place of the k-th zero the first position of a high part, from which a successor
search scans a few low parts.
"""

from __future__ import annotations

import numpy as np

_BYTE = np.arange(256)
_BITS = (_BYTE[:, None] >> np.arange(8)) & 1
_ONES = _BITS.sum(axis=1).astype(np.int64)
#: place of the j-th one of a byte
_PLACE = np.array([list(np.flatnonzero(b)) + [8] * (8 - b.sum()) for b in _BITS], dtype=np.int64)


class Bits:
    """A bit vector (bytes, least significant bit first) with the place of the k-th one and zero."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        self.ones = np.r_[0, np.cumsum(_ONES[packed])].astype(np.int32)
        self.zeros = (np.arange(len(self.ones)) * 8 - self.ones).astype(np.int32)

    def place(self, k: np.ndarray, one: bool) -> np.ndarray:
        counts = self.ones if one else self.zeros
        at = np.searchsorted(counts, k.astype(np.int32), side="right") - 1
        byte = self.packed[at] if one else ~self.packed[at]
        return at * 8 + _PLACE[byte, k - counts[at]]


class EliasFano:
    """A non-decreasing sequence of non-negative integers under ``universe``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, Bits(high)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """(length, low bits, low parts, high bit vector): all that is stored."""
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        low_bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        kind = np.uint8 if low_bits <= 8 else np.uint16 if low_bits <= 16 else np.uint32 if low_bits <= 32 else np.uint64
        low = (values & ((1 << low_bits) - 1)).astype(kind)
        size = (n + (universe >> low_bits) + 2 + 7) // 8 * 8
        bits = np.zeros(size, dtype=np.uint8)
        bits[(values >> low_bits) + np.arange(n)] = 1
        return n, low_bits, low, np.packbits(bits, bitorder="little")

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self.high.place(i, True) - i) << self.low_bits) | self.low[i].astype(np.int64)

    def successor(self, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first position in [begin, end) whose value is not less than ``value``; ``end`` if there is none."""
        high, low = value >> self.low_bits, value & ((1 << self.low_bits) - 1)
        before = np.zeros(len(value), dtype=np.int64)
        some = high > 0
        before[some] = self.high.place(high[some] - 1, False) - (high[some] - 1)
        stop = np.maximum(np.minimum(self.high.place(high, False) - high, end), begin)
        at = np.minimum(np.maximum(before, begin), stop)
        going = np.flatnonzero(at < stop)  # low parts ascend within a high part
        a, b, low = at[going], stop[going], low[going]
        while len(going):
            middle = (a + b) >> 1
            less = self.low[middle] < low
            a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
            more = a < b
            done = ~more
            at[going[done]] = a[done]
            going, a, b, low = going[more], a[more], b[more], low[more]
        return at


class Codebook:
    """Numbers in one byte each: the nearest of up to 256 of their own quantiles."""

    @staticmethod
    def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(values):
            return np.zeros(1), np.zeros(0, dtype=np.uint8)
        book = np.unique(np.quantile(values, np.linspace(0, 1, 256)))
        right = np.clip(np.searchsorted(book, values), 1, max(len(book) - 1, 1)) if len(book) > 1 else np.zeros(len(values), dtype=np.int64)
        left = np.maximum(right - 1, 0)
        return book, np.where(np.abs(book[right] - values) < np.abs(book[left] - values), right, left).astype(np.uint8)
