"""64-bit hashes of all words of many texts at once, and of any stretch of them."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20)
#: A random number for each byte value, 0 for the six white space characters.
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP, _BASE = (int(x) | 1 for x in _RNG.integers(1, 1 << 63, 2, np.uint64))
_BACK = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(_STEP, 256)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (one to one)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(at: np.ndarray) -> np.ndarray:
    """_STEP to the power of each place in a word; places past 255 by square and multiply."""
    if not len(at) or at.max() < len(_POWERS):
        return _POWERS[at]
    out, base, left = np.ones(len(at), np.uint64), _STEP, at.copy()
    while left.any():
        out = np.where(left & 1, out * np.uint64(base), out)
        base = base * base % (1 << 64)
        left >>= 1
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (runs without ``\\x20\\x09-\\x0D``) of the texts in order, and each text's number of words.

    A word's hash is the sum of its bytes' random numbers times the powers of
    a step by place, mixed: equal words have equal hashes, different ones
    differ but for one chance in about 2^64.
    """
    raw = np.frombuffer(b" ".join([*texts, b""]) if texts else b"", np.uint8)
    space = _SPACE[raw]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(raw) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    last = np.flatnonzero(~space & np.concatenate((space[1:], [True])))
    inside = np.flatnonzero(~space)
    lens = last - first + 1
    begin = np.cumsum(lens) - lens
    place = inside - np.repeat(first, lens)
    sums = np.add.reduceat(_BYTE[raw[inside]] * _power(place), begin)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    upto = np.searchsorted(first, ends)
    return mixed(sums + lens.astype(np.uint64)), np.diff(upto, prepend=0)


class Grams:
    """Hash of any stretch of a sequence of word hashes, from sums of the words times rising powers of a base."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers(_BASE, n), out=self.sums[1:])
        self.back = powers(_BACK, n)

    def of(self, k: int) -> np.ndarray:
        """The hashes of all stretches of k words, by start."""
        m = len(self.back) - k + 1
        return (self.sums[k:] - self.sums[:m]) * self.back[:m] if m > 0 else np.zeros(0, np.uint64)

    def between(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The hashes of the (non-empty) stretches [start, stop)."""
        return (self.sums[stop] - self.sums[start]) * self.back[start]
