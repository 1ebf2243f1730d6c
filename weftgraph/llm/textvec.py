"""Words and word shingles of many texts at once, as numpy arrays over their joint UTF-8 bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D. All hashes are 64-bit and the same on every machine.
"""

from __future__ import annotations

import numpy as np

_u = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _u(2) + _u(1)
_BASE, _STEP, _GOLD = _u(0x9E3779B97F4A7C15 | 5), _u(0xD6E8FEB86659FD93), _u(0x9E3779B97F4A7C15)
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def powers(n: int, sign: int = 1) -> np.ndarray:
    """Powers 0 to n-1 of the base, or of its inverse, modulo 2^64."""
    if len(_powers[sign]) < n:
        factor = _u(pow(int(_BASE), sign, 1 << 64))
        _powers[sign] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1024) - 1, factor)]), dtype=np.uint64)
    return _powers[sign][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by text): word offsets[d]:offsets[d+1] are the words of text d."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[1:-1]
    before[inner[inner < n]] = False
    after[inner[inner > 0] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(first)
    length = ends - starts
    inside = ~SPACE[data]
    values = np.zeros(len(data), np.uint64)
    values[inside] = _BYTE[data[inside]] * powers(int(length.max()) + 1)[place[inside]]
    return mix(np.add.reduceat(values, starts) + length.astype(np.uint64) * _GOLD)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values, whichever texts they are in."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out = out * _STEP + hashes[i : i + n]
    return mix(out)


def shingles(hashes: np.ndarray, by_text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by text) of k-word shingles; a text of 1 to k-1 words has one, of all of them."""
    count = np.diff(by_text)
    offsets = np.concatenate([[0], np.cumsum(np.where(count >= k, count - k + 1, np.minimum(count, 1)))]).astype(np.int64)
    out = np.zeros(offsets[-1], np.uint64)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(hashes)) - by_text[text]
    at = np.flatnonzero(place + k <= count[text])
    out[offsets[text[at]] + place[at]] = windows(hashes, k)[at]
    for d in np.flatnonzero((count > 0) & (count < k)):
        own = hashes[by_text[d] : by_text[d + 1]]
        out[offsets[d]] = mix(windows(own, len(own)) + _u(len(own)))[0]
    return out, offsets


def occurrence_labelled(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hashes with the number of equal ones before them in the same text worked in: unique within a text."""
    if len(hashes) == 0:
        return hashes
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    place = np.arange(len(h))
    rank = np.empty(len(h), np.uint64)
    rank[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return np.where(rank == 0, hashes, mix(hashes + rank * _GOLD))
