"""A compressed FM-index in numpy: packed wavelet tree, vectorised backward search."""

from __future__ import annotations

import numpy as np


class BitRank:
    """Bits in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Ranks of any symbol in a sequence, by one packed level per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            ones = ((symbols >> bit) & 1).astype(bool)
            self.levels.append(BitRank(ones))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.base = self.descend(np.zeros(size, np.int64), np.arange(size, dtype=np.int64))

    def descend(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for bit, level in zip(range(self.bits - 1, -1, -1), self.levels):
            ones = level.ones(at)
            at = np.where((symbol >> bit) & 1, level.zeros + ones, at - ones)
        return at

    def rank(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` among the first ``at`` entries."""
        return self.descend(at, symbol) - self.base[symbol]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``depth`` symbols, by doubling."""
    n = len(text)
    rank, known = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while known < depth:
        after = np.zeros(n, np.int64)
        after[: n - known] = rank[known:] + 1 if known < n else after[: n - known]
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.r_[0, (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)])
        rank, known = fresh, known * 2
    return order


class FMIndex:
    """Index of a text over 0..size-1 for patterns of up to ``depth`` symbols.

    ``weights``: how often each place of the text counts. Symbol 0 separates
    strings and belongs to no pattern.
    """

    def __init__(self, text: np.ndarray, size: int, depth: int, weights: np.ndarray):
        order = suffix_order(text, depth)
        self.tree = WaveletTree(text[order - 1], size)
        self.first = np.zeros(size + 1, np.int64)
        self.first[1:] = np.cumsum(np.bincount(text, minlength=size))
        self.weight = np.zeros(len(text) + 1, np.int64)
        self.weight[1:] = np.cumsum(weights[order])

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, most: int, least: int = 2) -> np.ndarray:
        """For each place of ``ends`` the length of the longest match that ends
        there and occurs ``least`` times in the indexed text, ``most`` at most.

        ``text`` is streamed against the index; its separators (0) end a match.
        Backward search extends the matches of all places by a symbol at a time
        and lets go of those whose interval has become too light.
        """
        length = np.zeros(len(ends), np.int64)
        symbol = text[ends]
        low, high = self.first[symbol], self.first[symbol + 1]
        live = np.flatnonzero(symbol > 0)
        low, high = low[live], high[live]
        for k in range(1, most + 1):
            enough = self.weight[high] - self.weight[low] >= least
            live, low, high = live[enough], low[enough], high[enough]
            length[live] = k
            if k == most or not len(live):
                break
            symbol = np.where(ends[live] >= k, text[ends[live] - k], 0)
            inside = symbol > 0
            live, low, high, symbol = live[inside], low[inside], high[inside], symbol[inside]
            both = self.tree.rank(np.concatenate([low, high]), np.concatenate([symbol, symbol]))
            low, high = self.first[symbol] + both[: len(live)], self.first[symbol] + both[len(live) :]
        return length
