"""A compressed FM-index over word sequences: packed wavelet matrix, backward search for many patterns at once."""

from __future__ import annotations

from itertools import chain

import numpy as np


_COLUMNS = 2048
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """Rank of symbols in a sequence: one packed bit vector with running counts for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, x = [], symbols
        for bit in range(bits - 1, -1, -1):
            ones = (x >> bit & 1).astype(bool)
            packed = np.packbits(np.concatenate([ones, np.zeros(64 + -len(ones) % 64, bool)]), bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int64)
            zeros = len(ones) - int(counts[-1])
            self.levels.append((bit, packed, counts, zeros))
            x = np.concatenate([x[~ones], x[ones]])
        self.base = self.map(np.arange(1 << bits, dtype=np.int64), np.zeros(1 << bits, np.int64))

    def map(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``at`` has a position for every symbol, or rows of them; so many columns at a time that they stay in the cache."""
        out = np.empty_like(at)
        for k in range(0, at.shape[-1], _COLUMNS):
            s, x = symbol[k : k + _COLUMNS], at[..., k : k + _COLUMNS]
            for bit, packed, counts, zeros in self.levels:
                word = x >> 6
                ones = packed[word]
                ones &= _BELOW[x & 63]
                rank = counts[word]
                rank += np.bitwise_count(ones)
                x = np.where((s >> bit & 1).astype(bool), rank + zeros, x - rank)
            out[..., k : k + _COLUMNS] = x
        return out

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self.map(symbol, at) - self.base[symbol]


class FmIndex:
    """An index of weighted sequences; counts of a pattern are sums of the weights of where it occurs.

    ``flat`` holds all sequences' symbols (1 and up), each closed by 0. Suffixes are sorted by as many symbols as
    the longest sequence has, so patterns up to that length are counted exactly.
    """

    def __init__(self, flat: np.ndarray, weights: np.ndarray, depth: int):
        n = len(flat)
        rank, width = flat.astype(np.int64), 1
        while width < depth:
            ahead = np.zeros(n, np.int64)
            ahead[: n - width] = rank[width:] + 1
            _, rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)
            width *= 2
            if rank.max() == n - 1:
                break
        order = np.argsort(rank, kind="stable")
        self.bits = max(1, int(flat.max()).bit_length())
        self.tree = WaveletMatrix(flat[order - 1].astype(np.int64), self.bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=1 << self.bits))]).astype(np.int64)
        self.weight = np.concatenate([[0], np.cumsum(weights[order])])
        self.n = n

    def extend(self, ranges: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The suffix ranges, a row of starts and a row of ends, of the patterns with ``symbol`` put before them."""
        return self.before[symbol] + self.tree.rank(symbol, ranges)


class Matches:
    """Where sequences of an index occur again: intervals of at least ``window`` words with a count of two or more."""

    def __init__(self, sequences: list[list[bytes]], weights: list[int], window: int):
        self.window, self.weights, self.length = window, np.array(weights, np.int64), np.array([len(s) for s in sequences], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length + 1)[:-1]]).astype(np.int64)
        words = list(chain.from_iterable(sequences))
        ids = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
        self.flat = np.zeros(len(words) + len(sequences), np.int64)
        inner = np.ones(len(self.flat), bool)
        inner[self.start + self.length] = False
        self.flat[inner] = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        every = np.repeat(self.weights, self.length + 1)
        self.index = FmIndex(self.flat, every, int(self.length.max()))

    def _back(self, seq: np.ndarray, end: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Backward search from ``end``: the smallest p, not under ``least``, such that the words from p to ``end`` recur."""
        p, live, weight = end.copy(), np.arange(len(seq)), self.index.weight
        at, ranges = self.start[seq] + end - 1, np.zeros((2, len(seq)), np.int64)
        ranges[1] = self.index.n
        while len(live):
            ranges = self.index.extend(ranges, self.flat[at])
            again = weight[ranges[1]] - weight[ranges[0]] >= 2
            if not again.all():
                live, at, ranges = live[again], at[again], ranges[:, again]
            at = at - 1
            p[live] -= 1
            more = p[live] > least[live]
            if not more.all():
                live, at, ranges = live[more], at[more], ranges[:, more]
        return p

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(sequence, from, to)``: maximal stretches whose every window occurs at least twice in the index.

        A sequence that stands for two places recurs whole. For the others one search from the end says whether they do,
        or which of their last words do. Before those, a search that fails at p rules out all windows that hold the words
        from p - 1 on, and the next window starts at p. One that reaches the window's start goes on to the farthest end
        that still recurs.
        """
        w = self.window
        seq = np.flatnonzero(self.length >= w)
        twice = seq[self.weights[seq] > 1]
        out, seq = [(twice, np.zeros(len(twice), np.int64), self.length[twice])], seq[self.weights[seq] < 2]
        last = self.length[seq].copy()  # windows that end after it are settled
        p = self._back(seq, last, np.zeros(len(seq), np.int64))
        found = last - p >= w
        out.append((seq[found], p[found], last[found]))
        last = np.where(found, p - 1 + w, last - 1)
        s = np.zeros(len(seq), np.int64)
        seq, last, s = (x[last >= w] for x in (seq, last, s))
        while len(seq):
            p = self._back(seq, s + w, s)
            hit = p == s
            good, at, end = seq[hit], s[hit], last[hit].copy()
            if len(good):
                bad = np.flatnonzero(self._back(good, end, at) > at)
                high = end.copy()
                end[bad] = at[bad] + w
                while len(bad := bad[high[bad] - end[bad] > 1]):
                    mid = (end[bad] + high[bad]) // 2
                    ok = self._back(good[bad], mid, at[bad]) == at[bad]
                    end[bad[ok]], high[bad[~ok]] = mid[ok], mid[~ok]
                out.append((good, at, end))
            s = p.copy()
            s[hit] = end - w + 1
            keep = s + w <= last
            seq, s, last = seq[keep], s[keep], last[keep]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
