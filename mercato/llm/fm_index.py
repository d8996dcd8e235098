"""FM-index over a sequence of small integers, all queries at once in numpy.

Suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix
(one bit vector with running counts for each bit of the alphabet), suffix positions
kept for every ``SAMPLE``-th place of the text.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, 2 * step
        if step >= n:
            return np.argsort(rank, kind="stable")


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros, self.levels = bits, [], [], []
        for level in reversed(range(bits)):
            bit = ((seq >> level) & 1).astype(bool)
            self.levels.append(bit)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at``."""
        low = np.zeros_like(at)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            at = np.where(bit, zeros + ones[at], at - ones[at])
            low = np.where(bit, zeros + ones[low], low - ones[low])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for level, ones, zeros in zip(self.levels, self.ones, self.zeros, strict=True):
            bit = level[at]
            symbol = 2 * symbol + bit
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Of ``text``, symbols from 1 on; 0 ends it."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        self.last = WaveletMatrix(text[order - 1], max(1, int(symbols).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.marked = order % SAMPLE == 0
        self.mark_rank = np.cumsum(self.marked) - 1
        self.sampled = order[self.marked]
        self.size = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phrases: one in a row -> the range of suffixes that begin with each."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for j in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, j]
            low[alive] = self.before[symbol] + self.last.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.last.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        dead = np.ones(len(phrases), bool)
        dead[alive] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffix rows: step back to the nearest kept one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.marked[rows])
        while len(todo):
            symbol = self.last.access(rows[todo])
            rows[todo] = self.before[symbol] + self.last.rank(symbol, rows[todo])
            steps[todo] += 1
            todo = todo[~self.marked[rows[todo]]]
        return self.sampled[self.mark_rank[rows]] + steps
