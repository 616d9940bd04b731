"""Elias-Fano sequences over numpy arrays that may be memory-mapped files."""

from __future__ import annotations

import os

import numpy as np

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Words of 64 bits between two entries of the rank directory.
_STEP = 8


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Fixed-width numbers one after the other in 64-bit words (one spare word at the end)."""
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, values << shift)
        over = np.flatnonzero((at & 63) + width > 64)
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


class EliasFano:
    """A sequence that never falls: low bits packed, high bits as the gaps of a bit vector with a rank directory."""

    names = ("low", "high", "ranks", "meta")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.low, self.high, self.ranks = (parts[k] for k in self.names[:3])
        self.n, self.width = (int(x) for x in parts["meta"])
        self.zeros = np.arange(len(self.ranks), dtype=np.int64) * (64 * _STEP) - self.ranks

    @staticmethod
    def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        """Arrays for ``values`` (uint64, sorted, all below ``universe``)."""
        n = len(values)
        width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        low = _pack_bits(values & ((np.uint64(1) << np.uint64(width)) - np.uint64(1)), width)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = n + (universe >> width) + 2
        bits = np.zeros((size // (64 * _STEP) + 1) * 64 * _STEP, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(high).reshape(-1, _STEP).sum(1, dtype=np.int64)
        return {"low": low, "high": high, "ranks": np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64),
                "meta": np.array([n, width], np.int64)}

    def save(self_parts: dict[str, np.ndarray], folder: str, name: str) -> None:  # noqa: N805 - takes build()'s arrays
        for k, v in self_parts.items():
            np.save(os.path.join(folder, f"{name}.{k}.npy"), v)

    @classmethod
    def mapped(cls, folder: str, name: str) -> EliasFano:
        return cls({k: np.load(os.path.join(folder, f"{name}.{k}.npy"), mmap_mode="r") for k in cls.names})

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th (from 0) set or unset high bit."""
        counts = self.ranks if one else self.zeros
        block = np.searchsorted(counts, k, side="right") - 1
        rest, word = k - counts[block], block * _STEP
        for _ in range(_STEP - 1):
            found = np.bitwise_count(self.high[word]).astype(np.int64)
            found = found if one else 64 - found
            on = rest >= found
            rest, word = rest - found * on, word + on
        bits = self.high[word] if one else self.high[word] ^ _ALL
        at = word * 64
        for half in (32, 16, 8, 4, 2, 1):
            found = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
            on = rest >= found
            rest, at = rest - found * on, at + half * on
            bits = bits >> (on * half).astype(np.uint64)
        return at

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        left = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, 1)), np.uint64(0))
        return ((self.low[word] >> shift) | left) & np.uint64((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.width)) | self._lows(i)

    def find(self, values: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Index of the first element that is not less than each value, between ``low`` and ``high`` where given."""
        h = (values >> np.uint64(self.width)).astype(np.int64)
        start = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - np.maximum(h - 1, 0), 0)
        stop = self._select(h, False) - h
        if low is not None:
            start, stop = np.clip(start, low, high), np.clip(stop, low, high)
        want = values & np.uint64((1 << self.width) - 1)
        while (open_ := start < stop).any():
            mid = (start + stop) // 2
            less = open_ & (self._lows(np.minimum(mid, self.n - 1)) < want)
            start, stop = np.where(less, mid + 1, start), np.where(open_ & ~less, mid, stop)
        return start
