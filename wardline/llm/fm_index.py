"""An FM-index in numpy: suffix array, wavelet tree over the BWT, sampled positions.

Backward search and locating are vectorised over patterns, not over text.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling. ``symbols`` must end in a symbol that is smaller than all others and occurs once."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-k] = rank[k:] + 1
        both = rank * (n + 1) + second
        order = np.argsort(both, kind="stable")
        ordered = both[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = fresh
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class WaveletTree:
    """Level-wise wavelet matrix: a bit plane a level, zeros moved ahead of ones, with running counts."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo, hi = np.zeros_like(upto), upto
        for i in range(self.levels):
            bit = (symbol >> (self.levels - 1 - i)) & 1
            one = self.ones[i]
            lo1, hi1 = one[lo], one[hi]
            lo = np.where(bit == 1, self.zeros[i] + lo1, lo - lo1)
            hi = np.where(bit == 1, self.zeros[i] + hi1, hi - hi1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for i in range(self.levels):
            one = self.ones[i]
            bit = one[at + 1] - one[at]
            out = out * 2 + bit
            at = np.where(bit == 1, self.zeros[i] + one[at], at - one[at])
        return out


class FMIndex:
    """Over symbols 1 to ``n_symbols`` - 1; 0 is put at the end."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        text = np.append(symbols, 0).astype(np.int64)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.tree = WaveletTree(bwt, n_symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.sampled = sa % SAMPLE == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = sa[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of patterns, rows padded on the right."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.before[-1], np.int64)
        live = np.arange(len(patterns))
        for step in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > step) & (lo[live] < hi[live])]
            if not len(live):
                break
            s = patterns[live, lengths[live] - 1 - step]
            lo[live] = self.before[s] + self.tree.rank(s, lo[live])
            hi[live] = self.before[s] + self.tree.rank(s, hi[live])
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to the nearest sampled one."""
        at, steps = at.copy(), np.zeros(len(at), np.int64)
        todo = np.flatnonzero(~self.sampled[at])
        while len(todo):
            s = self.tree.access(at[todo])
            at[todo] = self.before[s] + self.tree.rank(s, at[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[at[todo]]]
        return self.samples[self.sample_rank[at]] + steps
