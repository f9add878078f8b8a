"""Elias-Fano sequences over a byte buffer, searched as columns."""

from __future__ import annotations

import numpy as np

ONES = np.array([[i for i in range(8) if b >> i & 1] + [0] * (8 - bin(b).count("1")) for b in range(256)], np.int64)  # places of set bits of a byte


def pack_low(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, one after the other, least bit first."""
    if not width or not len(values):
        return np.zeros(8, np.uint8)
    parts = []
    for a in range(0, len(values), 1 << 16):  # whole bytes, as 8 divides the step
        octets = values[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        parts.append(np.packbits(np.unpackbits(octets, axis=1, count=width, bitorder="little").ravel(), bitorder="little"))
    return np.concatenate([*parts, np.zeros(16, np.uint8)])


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, with set-bit counts per byte as directory."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        self.words = np.ndarray(max(0, len(low) - 7), "<u8", low, strides=(1,))  # the 8 bytes from each byte
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        self.zeros = np.arange(len(high) + 1) * 8 - self.before

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        """(n, width of low bits, low bytes, high bytes)."""
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        marks = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros((top >> width) + n + 1, np.uint8)
        high[marks] = 1
        return n, width, pack_low(values, width), np.packbits(high, bitorder="little")

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        at = bit >> 3
        word = self.words[at]
        shift = (bit & 7).astype(np.uint64)
        word >>= shift
        if self.width > 57:
            word |= np.where(shift > 0, self.low[at + 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return word & np.uint64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the given positions."""
        byte = np.searchsorted(self.before, i, side="right") - 1
        place = byte * 8 + ONES[self.high[byte], i - self.before[byte]]
        return ((place - i).astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        """Number of values whose high part is below ``h``."""
        k = np.maximum(h - 1, 0)
        k = np.minimum(k, int(self.zeros[-1]) - 1)
        byte = np.searchsorted(self.zeros, k, side="right") - 1
        place = byte * 8 + ONES[255 - self.high[byte], k - self.zeros[byte]]
        return np.minimum(np.where(h > 0, place - k, 0), self.n)

    def search(self, x: np.ndarray) -> np.ndarray:
        """First position whose value is at least x (n if none)."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        last = int(self.get(np.array([self.n - 1]))[0])
        h = np.minimum(x >> np.uint64(self.width), np.uint64((last >> self.width) + 1)).astype(np.int64)
        lo, hi = self._bucket(h), self._bucket(h + 1)
        hi = np.where(x > last, self.n, hi)
        lo = np.where(x > last, self.n, lo)
        want = x & np.uint64((1 << self.width) - 1)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            open_ = lo < hi
            less = self._low(np.minimum(mid, self.n - 1)) < want
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo
