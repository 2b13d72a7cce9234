"""Anchors: the code words of the perfect binary code of length 23.

Its 4,096 words have distance 7 at least, and every 23-bit string lies within
3 bits of exactly one of them: as a covering code its radius is 3.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, RADIUS, MESSAGE = 23, 3, 12
#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_GENERATOR = 0b101011100011


def _remainder(x: int) -> int:
    for i in range(LENGTH - 1, 10, -1):
        if x >> i & 1:
            x ^= _GENERATOR << (i - 11)
    return x


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    low = np.array([_remainder(x) for x in range(1 << 12)], dtype=np.int32)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], dtype=np.int32)
    return low, high


@cache
def _patterns(weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Error patterns of at most ``weight`` bits, sorted by syndrome, and where each syndrome's begin."""
    found = [sum(1 << i for i in bits) for k in range(weight + 1) for bits in combinations(range(LENGTH), k)]
    of = np.array([_remainder(x) for x in found], dtype=np.int32)
    order = np.argsort(of, kind="stable")
    return np.array(found, dtype=np.int32)[order], np.searchsorted(of[order], np.arange((1 << 11) + 1))


def anchors(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit strings x: (row, anchor) for every anchor within ``radius`` of the row's string."""
    low, high = _syndromes()
    syndrome = low[x & 0xFFF] ^ high[x >> 12]
    patterns, begins = _patterns(radius)
    n = begins[syndrome + 1] - begins[syndrome]
    rows = np.repeat(np.arange(len(x)), n)
    inside = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    words = x[rows] ^ patterns[begins[syndrome[rows]] + inside]
    return rows, words >> 11


def reached(x: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, excess) for every anchor within RADIUS + slack; the excess is how far it lies beyond RADIUS."""
    nearest = anchors(x, RADIUS)[1]
    found = [(np.arange(len(x)), nearest, np.zeros(len(x), dtype=np.int8))]
    seen = np.sort(found[0][0] << MESSAGE | nearest)
    for k in range(1, slack + 1):
        rows, anchor = anchors(x, RADIUS + k)
        key = rows.astype(np.int64) << MESSAGE | anchor
        new = ~np.isin(key, seen)
        found.append((rows[new], anchor[new], np.full(int(new.sum()), k, dtype=np.int8)))
        seen = np.append(seen, key[new])
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def blocks(bits: int) -> list[tuple[int, int]]:
    """Cut a fingerprint into (first bit, length) of 23 bits each; a rest under 12 bits is left out."""
    cut = [(i, min(LENGTH, bits - i)) for i in range(0, bits, LENGTH)]
    return [b for b in cut if b[1] >= 12]


def block_of(words: list[np.ndarray], first: int, length: int) -> np.ndarray:
    """The block of each fingerprint, given as columns of unsigned 64-bit words, lowest bits first."""
    w, s = divmod(first, 64)
    x = words[w] >> np.uint64(s)
    if s + length > 64:
        x = x | words[w + 1] << np.uint64(64 - s)
    return (x & np.uint64((1 << length) - 1)).astype(np.int32)
