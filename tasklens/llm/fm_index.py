"""FM-index over a shard of words: suffix array, wavelet-tree ranks, backward
search of many patterns at once and positions by sampled suffixes (numpy)."""

from __future__ import annotations

import numpy as np

#: Largest text of one index (three ranks share a 63-bit sort key).
MAX_SYMBOLS = 1 << 20
SAMPLE = 8


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Suffix array of ``ranks`` (non-negative, below 2^21), whose suffixes all
    differ within the text; prefix tripling over the tied suffixes only."""
    n = len(ranks)
    padded = np.concatenate([ranks, [0, 0]]).astype(np.int64)
    key = padded[:n] << 42 | padded[1:n + 1] << 21 | padded[2:]
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    new = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 3
    while True:
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, n])
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return sa
        at = np.flatnonzero(tied)                 # places in sa
        i = sa[at]
        second = np.where(i + h < n, rank[np.minimum(i + h, n - 1)] + 1, 0)
        third = np.where(i + 2 * h < n, rank[np.minimum(i + 2 * h, n - 1)] + 1, 0)
        key = rank[i] << 42 | second << 21 | third
        order = np.argsort(key, kind="stable")
        sa[at], key = i[order], key[order]
        fresh = np.r_[True, key[1:] != key[:-1]]
        new[at] = fresh
        rank[sa[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
        h *= 3


class FMIndex:
    """Index of runs of symbols 1..sigma-1, each ended by a separator 0.

    Separators are told apart by their place, so suffixes are compared within
    their run only; patterns hold no separator.
    """

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        n = len(text)
        if n > MAX_SYMBOLS or n and text[-1]:
            raise ValueError("a shard ends with a separator and holds at most MAX_SYMBOLS")
        ends = text == 0
        m = int(ends.sum())
        # ranks of words are dense, so that they fit the sort key
        used = np.zeros(sigma, np.int64)
        used[text] = 1
        dense = np.cumsum(used) + m
        sa = suffix_array(np.where(ends, np.cumsum(ends) - 1, dense[text]))
        before = np.where(sa > 0, text[sa - 1], 0)
        self.n, self.levels = n, max(int(sigma - 1).bit_length(), 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.place = np.where((sa % sample == 0) | (before == 0), sa, -1)
        self.ones, self.zeros, level = [], [], before
        for b in range(self.levels - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(bit.sum()))
            level = level[np.argsort(bit, kind="stable")]
        self.base = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            one, r = (c >> (self.levels - 1 - k)) & 1, self.ones[k][i]
            i = np.where(one, self.zeros[k] + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``c`` among the first ``i`` symbols before suffixes."""
        return self._down(c, i) - self.base[c]

    def before(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol before each suffix row and the row of the suffix it begins."""
        c, i = np.zeros(len(rows), np.int64), rows
        for k in range(self.levels):
            r = self.ones[k][i]
            one = self.ones[k][i + 1] - r
            c = c * 2 + one
            i = np.where(one, self.zeros[k] + r, i - r)
        return c, self.first[c] + i - self.base[c]

    def search(self, patterns: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix row ranges [lo, hi) of patterns, aligned to the right."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        for s in range(patterns.shape[1]):
            go = np.flatnonzero((size > s) & (lo < hi))
            if not len(go):
                break
            c = patterns[go, patterns.shape[1] - 1 - s]
            lo[go] = self.first[c] + self.rank(c, lo[go])
            hi[go] = self.first[c] + self.rank(c, hi[go])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, left, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(left):
            at = self.place[rows]
            known = at >= 0
            out[left[known]] = at[known] + steps
            left, rows = left[~known], rows[~known]
            rows, steps = self.before(rows)[1], steps + 1
        return out
