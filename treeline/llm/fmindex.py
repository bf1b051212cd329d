"""An FM-index over integer sequences, vectorised over its queries with numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order. Symbol 0 ends a fragment; every 0 differs from all others, earlier ones first.

    Prefix doubling: ranks by the first 1, 2, 4, ... symbols until all differ.
    """
    n = len(text)
    ends = text == 0
    k0 = int(ends.sum())
    rank = text.astype(np.int64) + k0
    rank[ends] = np.arange(k0)
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2 + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = fresh
        width *= 2
        if width >= n or int(rank.max()) == n - 1:
            return order


class Wavelet:
    """Wavelet matrix: rank(symbol, i) = occurrences of the symbol before position i, for arrays of both."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))).astype(np.int32))
            self.zeros.append(int(len(seq) - self.ones[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros(len(symbol), np.int64)
        end = i.astype(np.int64)
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            ones, z = self.ones[level], self.zeros[level]
            a, b = ones[start], ones[end]
            start = np.where(one, z + a, start - a)
            end = np.where(one, z + b, end - b)
        return end - start


class FMIndex:
    """Count and locate patterns in fragments of symbols 1..size-1, each fragment closed by a 0."""

    def __init__(self, text: np.ndarray, size: int, sample: int = 8):
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))[:size]
        self.wavelet = Wavelet(self.bwt, max(1, int(size - 1).bit_length()))
        # Positions kept: every sample-th, and all at the start of a fragment, where walking back ends.
        kept = (sa % sample == 0) | (self.bwt == 0)
        self.kept, self.at = kept, np.cumsum(kept) - 1
        self.positions = sa[kept]
        self.n = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) whose suffixes begin with each pattern (one per row of a matrix), by backward search."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for c in patterns.T[::-1]:
            s = c[live]
            lo[live] = self.first[s] + self.wavelet.rank(s, lo[live])
            hi[live] = self.first[s] + self.wavelet.rank(s, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back by LF until a kept position, then add the steps."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.kept[rows])
        while len(todo):
            r = rows[todo]
            s = self.bwt[r]
            rows[todo] = self.first[s] + self.wavelet.rank(s, r)
            steps[todo] += 1
            todo = todo[~self.kept[rows[todo]]]
        return self.positions[self.at[rows]] + steps
