"""64-bit hashes of words and word shingles, computed over whole byte arrays."""

from __future__ import annotations

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64."""
    start = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(start + np.uint64(seed))


BYTES, PLACES = numbers(256, 11), numbers(1024, 23)


def words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of rows of bytes, and the borders of the rows in
    words. Words end at white space (\\x20, \\x09-\\x0D) and at the end of a row."""
    inside = ~BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = borders[:-1][np.diff(borders) > 0]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(borders), np.int64)
    word = np.cumsum(first) - 1
    place = np.arange(len(data)) - starts[np.maximum(word, 0)]
    far = place >= len(PLACES)
    weight = PLACES[np.where(far, 0, place)]
    if far.any():
        weight[far] = mixed(place[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    parts = np.where(inside, BYTES[FOLDED[data]] * (weight | np.uint64(1)), np.uint64(0))
    return mixed(np.add.reduceat(parts, starts)), np.searchsorted(starts, borders)


def shingles(hashes: np.ndarray, borders: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row its distinct shingles of ``size`` words, sorted; a row of fewer words, but not
    none, has one shingle of all of them."""
    weights = numbers(size, 37) | np.uint64(1)
    n = len(hashes)
    runs = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        runs += hashes[k : n - size + 1 + k] * weights[k] if len(runs) else runs
    runs = mixed(runs)
    out = []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            few = np.array([b - a], np.uint64)
            for k in range(b - a):
                few = mixed(few) + hashes[a + k : a + k + 1] * weights[k]
            out.append(mixed(few))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
