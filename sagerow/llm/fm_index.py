"""An FM-index over words: backward search over a wavelet matrix, matching statistics up to a threshold."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of any symbol in a sequence: one packed bit vector a bit of the symbols, with running counts."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.n = len(sequence)
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels = []
        for shift in range(self.bits - 1, -1, -1):
            ones = (sequence >> shift) & 1 == 1
            packed = np.zeros(self.n // 64 + 1, "<u8")
            raw = np.packbits(ones, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))).astype(np.int32)
            self.levels.append((shift, packed, counts, self.n - int(ones.sum())))
            sequence = np.concatenate((sequence[~ones], sequence[ones]))
        self.start = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, packed, counts, zeros in self.levels:
            word = at >> 6
            below = packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = counts[word] + np.bitwise_count(below)
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first ``at`` places."""
        return self._down(symbol, at) - self.start[symbol]


def _shifted(ranks: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(ranks)
    out[: max(0, len(ranks) - by)] = ranks[by:]
    return out


class FmIndex:
    """Index of a text of small numbers (0 ends a passage, words count from 1) for patterns of up to ``depth`` words.

    Suffixes are sorted by their first ``depth`` symbols, equal ones by
    place, which is all that backward search of such patterns needs. Kept
    are the Burrows-Wheeler transform as a wavelet matrix, the symbols'
    counts, the places of the rows, and the bounds of the rows that share
    their first depth - 1 symbols (what the search falls back to when its
    pattern is full).
    """

    def __init__(self, text: np.ndarray, depth: int):
        if not len(text) or text[-1] != 0:
            text = np.append(text, 0)
        self.depth, n = depth, len(text)
        symbols = int(text.max(initial=0)) + 1
        by = {1: text.astype(np.int64)}  # length -> rank of every place by that many symbols
        size = 1
        while size * 2 <= depth:
            key = by[size] * (by[size].max(initial=0) + 1) + _shifted(by[size], size)
            size *= 2
            by[size] = np.unique(key, return_inverse=True)[1]
        whole, done = by[size], size
        while done < depth:
            part = max(s for s in by if s <= depth - done)
            key = whole * (by[part].max(initial=0) + 1) + _shifted(by[part], done)
            done += part
            whole = np.unique(key, return_inverse=True)[1] if done < depth else key
        self.places = np.argsort(whole, kind="stable").astype(np.int32)
        self.wavelet = WaveletMatrix(text[self.places - 1], symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))[:-1]
        differ = np.zeros(n, bool)
        differ[:1] = True
        done = 0
        for part in sorted(by, reverse=True):
            while done + part <= depth - 1:
                ranks = _shifted(by[part], done)[self.places]
                differ[1:] |= ranks[1:] != ranks[:-1]
                done += part
        self.group = np.cumsum(differ, dtype=np.int32) - 1
        self.bounds = np.append(np.flatnonzero(differ), n)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of symbol + pattern from those of the pattern."""
        at = self.first[symbol]
        return at + self.wavelet.rank(symbol, low), at + self.wavelet.rank(symbol, high)

    def matches(self, query: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the passages of ``query`` match the text for ``depth`` words: their place, and the first such place in the text.

        All passages are read at once, right to left. A pattern that is full
        loses its last word (the rows sharing depth - 1 words) before the
        next one comes; one that ends in no row starts again one word earlier.
        Symbols below 1 or beyond the text's match nothing.
        """
        n, k = len(self.places), self.depth
        found, firsts = [], []
        begin = starts[lengths >= k]
        right = begin + lengths[lengths >= k] - 1
        at, low, high = right.copy(), np.zeros(len(begin), np.int64), np.full(len(begin), n, np.int64)
        while len(begin):
            symbol = query[at].astype(np.int64)
            known = (symbol >= 1) & (symbol < len(self.first))
            lo, hi = self.extend(np.where(known, symbol, 0), low, high)
            ok = known & (lo < hi)
            full = ok & (right - at + 1 == k)
            found.append(at[full])
            rows = lo[full]
            firsts.append(self.places[rows])
            shared = self.group[rows]
            lo[full], hi[full] = self.bounds[shared], self.bounds[shared + 1]
            low, high = np.where(ok, lo, 0), np.where(ok, hi, n)
            right = np.where(full | (known & ~ok), right - 1, np.where(ok, right, at - 1))
            at = np.where(ok, at - 1, right)
            left = right - begin + 1 >= k
            begin, right, at, low, high = begin[left], right[left], at[left], low[left], high[left]
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *found]), np.concatenate([empty, *firsts])
