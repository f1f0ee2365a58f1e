"""A full-text index over symbols: suffix array, wavelet matrix over its BWT, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of non-negative symbols, by prefix doubling over the ties that are left."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    bits = max(1, int(text.max() + 1).bit_length())
    width = max(1, 62 // bits)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key)
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    step = width
    while True:
        size = np.bincount(rank, minlength=n)
        live = np.flatnonzero(size[rank] > 1)
        if not len(live):
            break
        after = np.where(live + step < n, rank[np.minimum(live + step, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[live]))
        live, after = live[by], after[by]
        group = rank[live]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new = new_group | np.concatenate([[True], after[1:] != after[:-1]])
        index = np.arange(len(live))
        start = np.maximum.accumulate(np.where(new_group, index, 0))
        rank[live] = group + np.maximum.accumulate(np.where(new, index, 0)) - start
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletMatrix:
    """access and rank over an array of small integers, vectorised over queries."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros, now = bits, [], [], values
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            sums = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=sums[1:])
            self.ones.append(sums)
            self.zeros.append(len(now) - int(sums[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often symbol stands before position upto."""
        low, high = np.zeros_like(upto), upto
        for i, (sums, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            low = np.where(one, zeros + sums[low], low - sums[low])
            high = np.where(one, zeros + sums[high], high - sums[high])
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for sums, zeros in zip(self.ones, self.zeros, strict=True):
            one = sums[at + 1] - sums[at]
            out = (out << 1) | one
            at = np.where(one == 1, zeros + sums[at], at - sums[at])
        return out


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int = 8):
        """text: symbols >= 1; 0 marks the end and is appended here."""
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        bwt = text[order - 1]
        self.wavelet = WaveletMatrix(bwt, max(1, int(text.max()).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        self.marked = order % sample == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.samples = order[self.marked]

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.wavelet.rank(symbol, row)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [low, high) of equally long patterns, one a row, by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.flatnonzero((patterns < len(self.before) - 1).all(1))
        high[np.setdiff1d(np.arange(len(patterns)), alive)] = 0
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, j]
            low[alive], high[alive] = self.step(symbol, low[alive]), self.step(symbol, high[alive])
            alive = alive[high[alive] > low[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to the next sampled suffix."""
        out, walked, rows = np.zeros(len(rows), np.int64), 0, rows.copy()
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            done = self.marked[at]
            out[open_[done]] = self.samples[self.mark_rank[at[done]]] + walked
            open_, at = open_[~done], at[~done]
            rows[open_] = self.step(self.wavelet.access(at), at)
            walked += 1
        return out
