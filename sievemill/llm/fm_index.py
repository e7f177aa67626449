"""An FM-index over rows of word numbers: a packed wavelet matrix of the Burrows-Wheeler transform, searched backward.

All queries of a batch take each step of the search at once.
"""

from __future__ import annotations

import numpy as np

from sievemill.llm.suffix import suffix_array


class Bits:
    """A bit vector packed in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Finds how often substrings of up to ``depth`` symbols occur. Symbols are 1 and up; 0 ends the rows.

    The suffixes are sorted by depth symbols only, which is enough for the intervals of patterns of that length."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.depth = depth
        order, _ = suffix_array(text, 1, depth)
        bwt = text[order - 1]
        size = int(text.max()) + 1 if len(text) else 1
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(text, minlength=size))])
        self.size, self.n = size, len(text)
        self.levels: list[Bits] = []
        self.shifts = list(range(max(1, (size - 1).bit_length()) - 1, -1, -1))
        for shift in self.shifts:
            bits = ((bwt >> shift) & 1).astype(np.uint8)
            self.levels.append(Bits(bits))
            bwt = np.concatenate([bwt[bits == 0], bwt[bits == 1]])
        symbols = np.arange(size)
        self.base = self.descend(symbols, np.zeros(size, np.int64))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, level in zip(self.shifts, self.levels, strict=True):
            ones = level.ones(at)
            at = np.where((symbol >> shift) & 1, level.zeros + ones, at - ones)
        return at

    def search(self, query: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
        """Backward search of query[a:b] for each pair: the largest t with query[t:b] in fewer than ``least`` places of the
        text, or a - 1 if query[a:b] is in that many. Symbols that the text hasn't are below 1."""
        out = a - 1
        live = np.arange(len(a))
        at = b - 1
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.n, np.int64)
        while len(live):
            symbol = query[at[live]]
            known = symbol > 0
            if not known.all():
                out[live[~known]] = at[live[~known]]
                live, symbol, low, high = live[known], symbol[known], low[known], high[known]
            both = self.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            shift = self.first[symbol] - self.base[symbol]
            low, high = both[: len(live)] + shift, both[len(live) :] + shift
            dead = high - low < least
            out[live[dead]] = at[live[dead]]
            at[live] -= 1
            on = ~dead & (at[live] >= a[live])
            live, low, high = live[on], low[on], high[on]
        return out
