"""A compressed full-text index: suffix order, Burrows-Wheeler transform, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, compared to ``depth`` symbols at least (ties by position).

    Prefix doubling: ranks of 2k symbols come from pairs of ranks of k symbols.
    """
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        follow = np.zeros(n, dtype=np.int64)
        follow[: max(n - k, 0)] = rank[k:] + 1
        pair = rank * (n + 1) + follow
        order = np.argsort(pair, kind="stable")
        p = pair[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(p[1:] != p[:-1]))) if n else 0
        rank, k = new, 2 * k
        if k >= depth or n == 0 or rank.max() == n - 1:
            return np.argsort(rank, kind="stable")


class WaveletMatrix:
    """Symbols' bit planes, packed into 64-bit words with running counts: rank in time of the bits."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.planes, self.zeros = bits, [], []
        s = s.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            b = ((s >> level) & 1).astype(np.uint8)
            words = np.packbits(np.concatenate((b, np.zeros(-len(b) % 64 + 64, np.uint8))), bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]))
            self.planes.append((words, before))
            self.zeros.append(int(len(b) - b.sum()))
            s = np.concatenate((s[b == 0], s[b == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` occurs before place ``upto``, plus a constant of the symbol."""
        at = upto
        for (words, before), zeros, level in zip(self.planes, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            w = at >> 6
            ones = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Over symbols from 0; searches many patterns of one length at once."""

    def __init__(self, s: np.ndarray, depth: int):
        self.n = len(s)
        self.order = suffix_order(s, depth)
        size = int(s.max()) + 1 if self.n else 1
        bwt = s[self.order - 1]  # the text is read as a circle, it ends in a separator
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=size))))
        self.tree = WaveletMatrix(bwt, max(1, int(size - 1).bit_length()))
        # rank() of the matrix starts at a place of its own for each symbol
        every = np.arange(size, dtype=np.int64)
        self.base = self.tree.rank(every, np.zeros(size, dtype=np.int64))

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of rows of ``patterns`` from their ends backwards.

        Returns for each row the range [low, high) of suffixes that start with the longest
        suffix of the row that occurs, and its length.
        """
        m = len(patterns)
        low, high, length = np.zeros(m, np.int64), np.full(m, self.n, np.int64), np.zeros(m, np.int64)
        live = np.arange(m)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            lo = self.first[c] + self.tree.rank(c, low[live]) - self.base[c]
            hi = self.first[c] + self.tree.rank(c, high[live]) - self.base[c]
            ok = lo < hi
            live, lo, hi = live[ok], lo[ok], hi[ok]
            low[live], high[live] = lo, hi
            length[live] += 1
            if not len(live):
                break
        return low, high, length
