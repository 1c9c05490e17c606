"""A compressed full-text index over integer sequences: suffix array, BWT and wavelet matrix.

Ranks are answered for many positions at once, so a whole set of patterns is searched
backward in lockstep, one array operation per symbol and level.
"""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ``seq`` must end with its only smallest symbol."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + follow
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.cumsum(np.concatenate(([0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64))))
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class Bits:
    """A bit row in 64-bit words with a running count, answering rank in constant time."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1]
        self.ones = int(np.count_nonzero(bits))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class FMIndex:
    """Backward search over a sequence of symbols 0..sigma-1 with one bit row per level."""

    def __init__(self, seq: np.ndarray):
        self.sa = suffix_array(seq)
        n = len(seq)
        bwt = seq[self.sa - 1]
        sigma = int(seq.max()) + 1
        self.n = n
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma))))
        self.levels: list[Bits] = []
        self.height = max(1, (sigma - 1).bit_length())
        for level in range(self.height - 1, -1, -1):
            bits = (bwt >> level) & 1
            self.levels.append(Bits(bits))
            bwt = np.concatenate((bwt[bits == 0], bwt[bits == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position of the BWT (wavelet descent)."""
        lo, hi = np.zeros(len(i), np.int64), i.astype(np.int64)
        for level, bits in zip(range(self.height - 1, -1, -1), self.levels):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = bits.rank(lo), bits.rank(hi)
            zeros = self.n - bits.ones
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return hi - lo

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges after each pattern got one more symbol on its left."""
        both = self.rank(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        base = self.first[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]
