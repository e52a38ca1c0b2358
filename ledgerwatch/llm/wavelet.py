"""A wavelet matrix in numpy: ranks of small classes at any place of a sequence.

One bit vector per bit of a class, from the highest down; each is the classes' bits in the
order in which the bits above have sorted them, zeros first. A rank walks down the vectors
with one count of ones at each. Counts are kept per 64 bits, so a class of three bits takes
under a byte a symbol. Ranks are asked for many places at once. Nothing here knows Spark.
"""

from __future__ import annotations

import numpy as np


class BitRanks:
    """Ones before any place of a bit vector."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        self.words = padded.view("<u8")
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def __call__(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, classes: np.ndarray, bits: int = 3):
        self.length, self.bits = len(classes), bits
        self.levels: list[tuple[BitRanks, int]] = []
        for b in range(bits - 1, -1, -1):
            ones = (classes >> b & 1).astype(bool)
            self.levels.append((BitRanks(ones), len(classes) - int(ones.sum())))
            classes = np.concatenate([classes[~ones], classes[ones]])

    def rank(self, kind: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """How often ``kind`` occurs from ``first`` (included) to ``last`` (excluded), for each pair."""
        for b, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            if kind >> b & 1:
                first, last = zeros + ones(first), zeros + ones(last)
            else:
                first, last = first - ones(first), last - ones(last)
        return last - first

    def ranks(self, kinds: tuple[int, ...], first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The same for several classes together; of most classes, the rest is counted instead."""
        others = tuple(k for k in range(1 << self.bits) if k not in kinds)
        if len(others) < len(kinds):
            return (last - first) - self.ranks(others, first, last) if others else last - first
        return sum((self.rank(k, first, last) for k in kinds), np.zeros(len(first), np.int64))

    def furthest(self, kinds: tuple[int, ...], first: np.ndarray, last: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The largest place up to ``last`` with at most ``most`` of ``kinds`` between ``first`` and it: bisection on ranks."""
        low, high = first.copy(), last.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            fits = self.ranks(kinds, first, middle) <= most
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low
