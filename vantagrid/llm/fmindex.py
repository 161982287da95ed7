"""A compressed full-text index over sequences of integers, for one shard of text.

The Burrows-Wheeler transform of the shard is kept as a wavelet matrix: one
packed bit vector with counts for each bit of the symbols.  Backward search
extends a pattern to the left by one symbol for two rank queries; it runs for many
patterns side by side.  The suffix array isn't kept: what is asked of it is the earliest place among
the suffixes of an interval, so only their order numbers stay, four bytes each.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits; ``rank`` counts the ones before a place."""

    def __init__(self, bits: np.ndarray):
        whole = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        whole[: len(bits)] = bits
        self.words = np.packbits(whole, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, most: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        for bit in reversed(range(max(1, int(most).bit_length()))):
            ones = ((symbols >> bit) & 1).astype(bool)
            self.levels.append((bit, BitVector(ones), int((~ones).sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def narrow(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """Where each of ``ends`` comes to lie among the occurrences of ``symbol`` and what sorts before it."""
        out = list(ends)
        for bit, vector, zeros in self.levels:
            ones = ((symbol >> bit) & 1).astype(bool)
            for k, at in enumerate(out):
                rank = vector.rank(at)
                out[k] = np.where(ones, zeros + rank, at - rank)
        return out


class FMIndex:
    """Index of ``text`` (symbols from 1, 0 between its sequences) for patterns up to ``longest`` symbols.

    ``order`` numbers the places of the text; ``earliest`` tells the least of them in an interval.
    """

    def __init__(self, text: np.ndarray, longest: int, order: np.ndarray):
        n, most = len(text), int(text.max(initial=0))
        rank, span = text.astype(np.int64), 1
        while span < longest:
            after = np.zeros(n, np.int64)
            after[: n - span] = rank[span:] + 1
            rank = np.unique(rank * (n + most + 2) + after, return_inverse=True)[1]
            span *= 2
            if n and rank.max() == n - 1:
                break
        suffixes = np.argsort(rank, kind="stable")
        self.order = np.append(order[suffixes], n).astype(np.uint32)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))])
        self.matrix = WaveletMatrix(text[suffixes - 1], most)
        self.begin = self.matrix.narrow(np.arange(most + 1), np.zeros(most + 1, np.int64))[0]

    def single(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals [low, high) of patterns of one symbol."""
        return self.less[symbol], self.less[symbol + 1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after one step of backward search: ``symbol`` is put before each pattern."""
        a, b = self.matrix.narrow(symbol, low, high)
        start = self.less[symbol] - self.begin[symbol]
        return a + start, b + start

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least order number in each interval; none is empty, and patterns have one length, so intervals are equal or apart."""
        cuts, at, back = np.unique(low, return_index=True, return_inverse=True)
        bounds = np.stack([cuts, high[at]], axis=1).ravel()
        return np.minimum.reduceat(self.order, bounds)[::2][back].astype(np.int64)
