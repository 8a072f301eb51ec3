"""Static 3-wise binary fuse filters over 64-bit keys, built and asked with numpy."""

from __future__ import annotations

import math
import struct

import numpy as np

_HEAD = "<QII"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots a key, in three neighbouring segments."""
    low = np.uint64(segment - 1)
    s0 = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    s1 = (s0 + np.uint64(segment)) ^ ((h >> np.uint64(18)) & low)
    s2 = (s0 + np.uint64(2 * segment)) ^ (h & low)
    return np.stack([s0, s1, s2]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of distinct unsigned 64-bit keys: a header and one byte a slot (about 1.13 to 1.4 a key)."""
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    if n == 0:
        return struct.pack(_HEAD, 0, 0, 0)
    segment = 1 << max(2, min(18, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / segment) - 2)
    size = (segments + 2) * segment
    seed = 0
    while True:
        seed += 0x9E3779B97F4A7C15
        seed &= (1 << 64) - 1
        h = _mix(keys, seed)
        slots = _slots(h, segment, segments)
        degree = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # sum of the keys' numbers in a slot: the key itself where one is left
        for s in slots:
            np.add.at(held, s, np.arange(n))
        peeled, left = [], n
        while True:
            alone = np.flatnonzero(degree == 1)
            if not len(alone):
                break
            who, first = np.unique(held[alone], return_index=True)
            peeled.append((who, alone[first]))
            left -= len(who)
            for s in slots[:, who]:
                np.subtract.at(degree, s, 1)
                np.subtract.at(held, s, who)
        if left == 0:
            break
    table, prints = np.zeros(size, np.uint8), _prints(h)
    for who, slot in reversed(peeled):
        a, b, c = slots[:, who]
        table[slot] = 0
        table[slot] = prints[who] ^ table[a] ^ table[b] ^ table[c]
    return struct.pack(_HEAD, seed, segment, segments) + table.tobytes()


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter: true for all its keys, and for about 1 in 256 others."""
    seed, segment, segments = struct.unpack_from(_HEAD, blob)
    keys = np.asarray(keys, np.uint64)
    if not segment:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint8, offset=struct.calcsize(_HEAD))
    h = _mix(keys, seed)
    a, b, c = _slots(h, segment, segments)
    return (table[a] ^ table[b] ^ table[c]) == _prints(h)
