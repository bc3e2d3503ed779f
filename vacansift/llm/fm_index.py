"""An FM-index over whole words, with a wavelet matrix of packed bits, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


class _Bits:
    """A bit vector with rank: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    """Index of a sequence of symbols (numbers from 0). Suffixes are sorted by ``depth`` symbols, so patterns may have that many."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        self.suffixes = _sorted_suffixes(symbols, depth)
        last = symbols[self.suffixes - 1]  # the symbol before each suffix, cyclically
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1))])
        self.levels: list[_Bits] = []
        self.zeros: list[int] = []
        current = last
        width = max(1, int(symbols.max(initial=0)).bit_length())
        for shift in range(width - 1, -1, -1):
            bits = (current >> shift) & 1 == 1
            self.levels.append(_Bits(bits))
            self.zeros.append(int(n - bits.sum()))
            current = np.concatenate([current[~bits], current[bits]])
        self.size, self.width = n, width
        # Where the block of each symbol begins at the bottom of the matrix.
        self.block = self._down(np.arange(len(self.smaller) - 1), np.zeros(len(self.smaller) - 1, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in enumerate(self.levels):
            ones = bits.rank(at)
            high = (symbols >> (self.width - 1 - level)) & 1 == 1
            at = np.where(high, self.zeros[level] + ones, at - ones)
        return at

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after putting a symbol before each pattern."""
        start = self.smaller[symbols] - self.block[symbols]
        return start + self._down(symbols, low), start + self._down(symbols, high)


def _sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, covered = len(symbols), 1
    order = np.argsort(rank, kind="stable")
    while covered < depth and n:
        ahead = np.zeros(n, np.int64)
        if covered < n:
            ahead[: n - covered] = rank[covered:] + 1
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        covered *= 2
    return order


class RangeMinimum:
    """Minima of ranges, from minima of all ranges of power-of-two length."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of values[low:high] for ranges that are not empty."""
        power = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), self.tables[0].dtype)
        for p in np.unique(power):
            some = power == p
            out[some] = np.minimum(self.tables[p][low[some]], self.tables[p][high[some] - (1 << int(p))])
        return out
