"""A compressed full-text index over sequences of word ids: BWT in a wavelet matrix, searched backwards.

Built and searched for whole arrays of sequences at a time. Bits are packed in 64-bit words with a running
count for each, so an index takes a few bits for each word and level.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Counts of any symbol before any place of a sequence, in one pass over the symbol's bits."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels):
            bit = (seq >> (self.levels - 1 - level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate((bit, np.zeros(-bit.size % 64 + 64, np.uint8))), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed)[:-1], dtype=np.int64))).astype(np.int32))
            self.zeros.append(int(bit.size - bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        self.leaf = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            at = place >> 6
            ones = self.before[level][at] + np.bitwise_count(self.words[level][at] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
            place = np.where(symbol >> (self.levels - 1 - level) & 1, self.zeros[level] + ones, place - ones)
        return place

    def count(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, place) - self.leaf[symbol]


class FmIndex:
    """An index of sequences given one after the other (``words``, values from 0; ``starts``, with the end).

    It holds the BWT in a wavelet matrix, the counts of the words, how many words (up to ``depth``) each suffix
    has in common with the one before it in sorted order, and, by this, where the suffixes that agree in so many
    words begin: a search gives up words of its context by stepping to these. Suffixes themselves are not kept,
    nor is the text.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, depth: int):
        n, pieces = words.size, starts.size - 1
        self.depth = depth
        # Each sequence ends in a mark of its own, smaller than all words.
        total = n + pieces
        at = np.arange(n) + np.repeat(np.arange(pieces), np.diff(starts))
        ends = starts[1:] + np.arange(pieces)
        text = np.zeros(total, np.int64)
        text[at] = words + 1
        rank = text + pieces - 1
        rank[ends] = np.arange(pieces)
        # Ranks by 1, 2, 4, ... words; a mark of its own within reach makes every suffix different in the end.
        ranks, length = {1: self._dense(rank)}, 1
        order = None
        while order is None or ranks[length].max() + 1 < total:
            r = ranks[length]
            later = np.concatenate((r[length:] + 1, np.zeros(min(length, total), np.int64)))[:total]
            key = r * (total + 2) + later
            order = np.argsort(key, kind="stable")
            length *= 2
            ranks[length] = self._dense_sorted(key, order)
        symbols = int(words.max()) + 2 if n else 1
        self.bwt = WaveletMatrix(text[order - 1], symbols)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.common = self._common(ranks, order, depth)
        self.cuts = [np.append(np.flatnonzero(self.common[:-1] < k) if k else 0, total).astype(np.int32) for k in range(depth)]
        self.size = total

    @staticmethod
    def _dense(values: np.ndarray) -> np.ndarray:
        return np.unique(values, return_inverse=True)[1]

    @staticmethod
    def _dense_sorted(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        out, k = np.empty(key.size, np.int64), key[order]
        out[order] = np.cumsum(np.concatenate(([0], k[1:] != k[:-1])))
        return out

    @staticmethod
    def _common(ranks: dict[int, np.ndarray], order: np.ndarray, depth: int) -> np.ndarray:
        """Words, up to ``depth``, that each suffix has in common with the one before it; 0 at both ends."""
        out, total = np.zeros(order.size + 1, np.uint8), order.size
        a, b = order[:-1].copy(), order[1:].copy()
        n = np.zeros(a.size, np.int64)
        for length in sorted(ranks, reverse=True):
            if length <= depth:
                for _ in range(2):
                    same = np.flatnonzero((a < total) & (b < total))
                    same = same[ranks[length][a[same]] == ranks[length][b[same]]]
                    for x in (a, b, n):
                        x[same] += length
        out[1:-1] = np.minimum(n, depth)
        return out

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes one word longer to the left."""
        s = symbol + 1
        places = self.bwt.count(np.concatenate((s, s)), np.concatenate((lo, hi)))
        return self.less[s] + places[: s.size], self.less[s] + places[s.size :]

    def statistics(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Matching statistics of streamed sequences: for every place, how many of the words from there on (up to
        ``depth``, and to the sequence's end) stand somewhere in the index.

        Sequences are read from the right. Where a word cannot be put before the context, the context gives up
        words at its end until there are more suffixes that it stands before, and the word is tried again.
        """
        out = np.zeros(words.size, np.int64)
        live = np.flatnonzero(np.diff(starts) > 0)
        first, at = starts[live], starts[live + 1] - 1
        lo, hi, n = np.zeros(live.size, np.int64), np.full(live.size, self.size, np.int64), np.zeros(live.size, np.int64)
        while at.size:
            full = np.flatnonzero(n == self.depth)
            if full.size:
                n[full] -= 1
                self._shorten(full, lo, hi, n)
            symbol = words[at]
            known = symbol < self.less.size - 2
            to_lo, to_hi = self.step(np.where(known, symbol, 0), lo, hi)
            ok = known & (to_lo < to_hi)
            n = np.where(ok, n + 1, n)
            out[at[ok]] = n[ok]
            lo, hi = np.where(ok, to_lo, lo), np.where(ok, to_hi, hi)
            failed = np.flatnonzero(~ok & (n > 0))
            # A word that the index has nowhere ends every context, and so does one that an empty one fails at.
            moved = ok | (n == 0)
            if failed.size:
                n[failed] = np.where(known[failed], np.maximum(self.common[lo[failed]], self.common[hi[failed]]), 0)
                self._shorten(failed, lo, hi, n)
            at = at - moved
            go_on = at >= first
            first, at, lo, hi, n = first[go_on], at[go_on], lo[go_on], hi[go_on], n[go_on]
        return out

    def _shorten(self, which: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> None:
        """Widen ranges to all the suffixes that agree in ``n`` words."""
        for k in np.unique(n[which]).tolist():
            some = which[n[which] == k]
            i = np.searchsorted(self.cuts[k], lo[some], "right")
            lo[some], hi[some] = self.cuts[k][i - 1], self.cuts[k][i]
