"""An FM-index over a shard's word numbers: wavelet-tree ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 32


class Bits:
    """A bit vector with ranks: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, bool)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)


class WaveletTree:
    """Ranks of symbols in a sequence. The nodes of a level lie in one bit vector, those with a zero bit first."""

    def __init__(self, symbols: np.ndarray, height: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(height - 1, -1, -1):
            bit = (symbols >> shift) & 1 == 1
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before i."""
        first = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            ones, ones_first = bits.rank(i), bits.rank(first)
            i = np.where(one, zeros + ones, i - ones)
            first = np.where(one, zeros + ones_first, first - ones_first)
        return i - first

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it stands before."""
        first, symbol = np.zeros_like(i), np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = bits.get(i)
            symbol |= one.astype(np.int64) << shift
            ones, ones_first = bits.rank(i), bits.rank(first)
            i = np.where(one, zeros + ones, i - ones)
            first = np.where(one, zeros + ones_first, first - ones_first)
        return symbol, i - first


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Rank of each suffix, by prefix doubling. Zeros are separators, each less than every later one; the last symbol is one."""
    n, ends = len(symbols), symbols == 0
    counts = np.bincount(symbols, minlength=1)
    starts = np.cumsum(counts) - counts
    rank = starts[symbols].astype(np.int64)
    rank[ends] = np.arange(counts[0])
    open_ = np.flatnonzero(~ends & (counts[symbols] > 1))
    step = 1
    while len(open_):
        old, ahead = rank[open_], rank[open_ + step]
        order = np.argsort(old * (n + 1) + ahead, kind="stable")
        at, old, ahead = open_[order], old[order], ahead[order]
        place = np.arange(len(at))
        group = np.r_[True, old[1:] != old[:-1]]
        part = group | np.r_[True, ahead[1:] != ahead[:-1]]
        part_start = np.maximum.accumulate(np.where(part, place, 0))
        rank[at] = old + part_start - np.maximum.accumulate(np.where(group, place, 0))
        single = part & np.r_[part[1:], True]
        open_ = at[~single]
        step *= 2
    return rank


class FMIndex:
    """Index of sequences of positive symbols (below 2**height), each ended by a zero."""

    def __init__(self, symbols: np.ndarray, height: int):
        n = len(symbols)
        rank = suffix_ranks(symbols)
        suffix = np.empty(n, np.int64)
        suffix[rank] = np.arange(n)
        self.before = np.r_[0, np.cumsum(np.bincount(symbols, minlength=1 << height))]
        sampled = (suffix % SAMPLE_EVERY == 0) | (symbols[suffix - 1] == 0)  # a sequence's start is always sampled
        self.sampled, self.samples = Bits(sampled), suffix[sampled]
        self.tree, self.n = WaveletTree(symbols[suffix - 1], height), n

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval [low, high) of each phrase: rows of symbols, right-aligned, of the given lengths."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, -back]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows: steps to the left until a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled.get(rows))
        while len(walking):
            symbol, before = self.tree.symbol_and_rank(rows[walking])
            rows[walking] = self.before[symbol] + before
            steps[walking] += 1
            walking = walking[~self.sampled.get(rows[walking])]
        return self.samples[self.sampled.rank(rows)] + steps
