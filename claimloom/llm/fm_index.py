"""An FM-index over a sequence of small integers: backward search by wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The suffix array, by doubling the length that suffixes are sorted by."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        step *= 2
        if step >= n or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """``symbols`` are at least 1; 0 is put at their end. Every ``sample``-th position is stored."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        s = np.concatenate((symbols, [0])).astype(np.int64)
        order = suffix_order(s)
        self.bwt = s[order - 1]
        self.bits = max(1, int(s.max()).bit_length())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=(1 << self.bits)))))
        self.levels, x = [], self.bwt
        for bit in range(self.bits - 1, -1, -1):
            ones = (x >> bit) & 1
            self.levels.append((np.concatenate(([0], np.cumsum(ones))).astype(np.int32), len(x) - int(ones.sum())))
            x = np.concatenate((x[ones == 0], x[ones == 1]))
        self.sampled = order % sample == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol of ``c`` is among the first ``i`` of the transformed sequence."""
        start, at = np.zeros(len(i), np.int64), i.astype(np.int64)
        for level, (ones, zeros) in enumerate(self.levels):
            bit = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = ones[start], ones[at]
            start, at = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, at - b)
        return at - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of sorted suffixes that begin with each row of ``phrases``."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j].astype(np.int64)
            known = c < (1 << self.bits)
            lo[live[~known]] = hi[live[~known]] = 0
            live, c = live[known], c[known]
            lo[live], hi[live] = self.before[c] + self.rank(c, lo[live]), self.before[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        found = np.zeros(len(phrases), bool)
        found[live] = True
        return np.where(found, lo, 0), np.where(found, hi, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of sorted suffixes: steps back to the next stored one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[rows])
        while len(open_):
            c = self.bwt[rows[open_]]
            rows[open_] = self.before[c] + self.rank(c, rows[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[rows[open_]]]
        return self.positions[self.sample_rank[rows]] + steps
