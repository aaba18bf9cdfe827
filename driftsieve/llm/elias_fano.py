"""Elias-Fano encoding of sorted 64-bit keys, with vectorised successor search and merging."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits, so that keys of any kind spread evenly and stay distinct."""
    x = x.astype(np.uint64)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class EliasFano:
    """A sorted set of integers below 2**bits: low bits packed, high bits in unary, about bits - log2(n) + 2 bits a key."""

    def __init__(self, keys: np.ndarray, bits: int = 64):
        keys = np.asarray(keys, np.uint64)
        self.n, self.bits = len(keys), bits
        self.low_bits = max(0, bits - max(1, int(self.n).bit_length()))
        self.buckets = 1 << (bits - self.low_bits)
        high = (keys >> _U(self.low_bits)).astype(np.int64) if self.low_bits < 64 else np.zeros(self.n, np.int64)
        size = (self.n + self.buckets + 63) // 64
        unary = np.zeros(size * 64, np.uint8)
        unary[high + np.arange(self.n)] = 1
        self.high = np.packbits(unary, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.high).astype(np.int64)
        #: zeros before each word of the unary part
        self.zeros = np.arange(size, dtype=np.int64) * 64 - (np.cumsum(ones) - ones)
        self.low = self._pack(keys & _U((1 << self.low_bits) - 1))

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.bits, len(self.high)], np.int64).tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "EliasFano":
        n, bits, words = np.frombuffer(data, np.int64, 3).tolist()
        out = cls(np.empty(0, np.uint64), bits)
        out.n, out.low_bits = n, max(0, bits - max(1, n.bit_length()))
        out.buckets = 1 << (bits - out.low_bits)
        body = np.frombuffer(data, np.uint64, offset=24)
        out.high, out.low = body[:words], body[words:]
        ones = np.bitwise_count(out.high).astype(np.int64)
        out.zeros = np.arange(words, dtype=np.int64) * 64 - (np.cumsum(ones) - ones)
        return out

    def _pack(self, low: np.ndarray) -> np.ndarray:
        width = self.low_bits
        words = np.zeros((self.n * width + 63) // 64 + 2, np.uint64)
        if width and self.n:
            at = np.arange(self.n, dtype=np.int64) * width
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(words, word, low << shift)
            over = np.flatnonzero(shift + _U(width) > 64)
            np.bitwise_or.at(words, word[over] + 1, low[over] >> (_U(64) - shift[over]))
        return words

    def _lows(self, i: np.ndarray) -> np.ndarray:
        width = self.low_bits
        if not width:
            return np.zeros(len(i), np.uint64)
        at = i * width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        value |= np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return value & _U((1 << width) - 1)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th zero of the unary part is."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        left, bits, pos = k - self.zeros[word], ~self.high[word], np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & _U((1 << step) - 1)).astype(np.int64)
            on = left >= count
            left = np.where(on, left - count, left)
            bits = np.where(on, bits >> _U(step), bits)
            pos += on * step
        return word * 64 + pos

    def _bounds(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = self._select0(high) - high
        before = np.maximum(high - 1, 0)
        start = np.where(high > 0, self._select0(before) - before, 0)
        return start, end

    def rank(self, x: np.ndarray) -> np.ndarray:
        """How many keys are less than each x: the place of its successor."""
        x = np.asarray(x, np.uint64)
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64)
        lo, hi = self._bounds((x >> _U(self.low_bits)).astype(np.int64))
        low = x & _U((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def contains(self, x: np.ndarray) -> np.ndarray:
        """Whether each x is its own successor."""
        x = np.asarray(x, np.uint64)
        if not self.n or not len(x):
            return np.zeros(len(x), bool)
        high = (x >> _U(self.low_bits)).astype(np.int64)
        at = self.rank(x)
        _, end = self._bounds(high)
        here = np.flatnonzero(at < end)
        out = np.zeros(len(x), bool)
        out[here] = self._lows(at[here]) == (x[here] & _U((1 << self.low_bits) - 1))
        return out

    def decode(self) -> np.ndarray:
        if not self.n:
            return np.empty(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64)
        return (high << _U(self.low_bits)) | self._lows(np.arange(self.n, dtype=np.int64))

    def merged(self, new: np.ndarray) -> "EliasFano":
        """With the new keys: sorted, distinct, none of them here yet."""
        old = self.decode()
        out = np.empty(len(old) + len(new), np.uint64)
        at = np.searchsorted(old, new) + np.arange(len(new))
        mask = np.ones(len(out), bool)
        mask[at] = False
        out[at], out[mask] = new, old
        return EliasFano(out, self.bits)

    def size_bits(self) -> int:
        return 64 * (len(self.high) + len(self.low) + len(self.zeros))
