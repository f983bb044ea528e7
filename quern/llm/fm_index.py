"""A compressed FM-index over sequences of small integers, and matching statistics from it, in numpy.

The Burrows-Wheeler transform of the indexed texts is kept as a wavelet matrix: one bit vector per binary
digit of a symbol, packed 64 to a word with a running count per word. Backward search runs for many
patterns in step, one left extension of each per round. Each suffix has a weight, and an interval of
suffixes weighs the sum of its suffixes': texts that occur many times are indexed once, weighted.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: packed words, and the ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)
        self.total = int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, digits: int) -> None:
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        self.digits = digits
        for d in reversed(range(digits)):
            bit = ((symbols >> d) & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            self.zeros.append(len(bit) - self.levels[-1].total)
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))
        every = np.arange(1 << digits)
        self.start = self._descend(every, np.zeros(len(every), np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, zeros, d in zip(self.levels, self.zeros, reversed(range(self.digits)), strict=True):
            ones = level.rank(at)
            at = np.where((symbol >> d) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before lo and before hi."""
        start = self.start[symbol]
        return self._descend(symbol, lo) - start, self._descend(symbol, hi) - start


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` symbols, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, span = np.argsort(rank, kind="stable"), 1
    while span < depth and rank.max(initial=0) < n - 1:
        key = rank * (n + 1)
        key[: n - span] += rank[span:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        span *= 2
    return order


class FMIndex:
    """Index of texts given one after another: `symbols` from 1 up, `first` where each begins, a weight each.

    Matches never run over the end of a text; patterns up to `depth` symbols are counted right.
    """

    def __init__(self, symbols: np.ndarray, first: np.ndarray, weights: np.ndarray, depth: int) -> None:
        lengths = np.diff(first)
        n = len(symbols) + len(lengths)
        text = np.zeros(n, np.int64)  # a 0 after each text
        place = np.arange(len(symbols)) + np.repeat(np.arange(len(lengths)), lengths)
        text[place] = symbols
        order = suffix_array(text, depth)
        self.size = n
        counts = np.bincount(text, minlength=int(text.max(initial=0)) + 2)
        self.below = np.concatenate(([0], np.cumsum(counts)))
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(text.max(initial=1)).bit_length()))
        each = np.repeat(weights, lengths + 1)
        self.weight = np.concatenate(([0], np.cumsum(each[order])))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of the patterns."""
        a, b = self.bwt.rank(symbol, lo, hi)
        return self.below[symbol] + a, self.below[symbol] + b

    def repeated(self, symbols: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int, int]]:
        """(text, from, to) of the maximal stretches of at least `least` symbols whose occurrences weigh two or more.

        The matching statistic of an end is the longest match that stops there and weighs two. From one
        end the search runs left until the match fails; no stretch reaches over the failing symbol from
        this end, so the next end is the one whose shortest stretch starts at that symbol, or one less.
        """
        lengths = np.diff(first)
        live = np.flatnonzero(lengths >= least)
        end = lengths[live].copy()
        at = end.copy()
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.size, np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            more = at > 0
            symbol = symbols[np.maximum(first[live] + at - 1, 0)]
            a, b = self.extend(symbol, lo, hi)
            grows = more & (self.weight[b] - self.weight[a] >= 2)
            lo, hi = np.where(grows, a, lo), np.where(grows, b, hi)
            at = at - grows
            stopped = ~grows
            if stopped.any():
                long = stopped & (end - at >= least)
                if long.any():
                    found.append((live[long], at[long], end[long]))
                end = np.where(long, at + least - 1, np.where(stopped, end - 1, end))
                at = np.where(stopped, end, at)
                lo, hi = np.where(stopped, 0, lo), np.where(stopped, self.size, hi)
                keep = ~(stopped & (~more | (end < least)))
                live, end, at, lo, hi = live[keep], end[keep], at[keep], lo[keep], hi[keep]
        return [(int(t), int(x), int(y)) for ts, xs, ys in found for t, x, y in zip(ts, xs, ys, strict=True)]
