"""Suffix sorting by a difference cover of period three, over arrays."""

from __future__ import annotations

import numpy as np


TABLE = 2**25  # values below it are named by a table


def _order(values: np.ndarray) -> np.ndarray:
    """A sorting order of numbers from 0; value and place are sorted in one word if they fit."""
    bits = max(len(values) - 1, 1).bit_length()
    if len(values) and int(values.max()).bit_length() + bits <= 63:
        return np.sort((values << bits) | np.arange(len(values))) & ((1 << bits) - 1)
    return np.argsort(values, kind="stable")


def _ranks(values: np.ndarray, below: int) -> tuple[np.ndarray, int]:
    """Ranks from 0 of numbers under ``below``, and how many differ."""
    if below <= TABLE:
        seen = np.zeros(below, bool)
        seen[values] = True
        dense = np.cumsum(seen, dtype=np.int32)
        return dense[values].astype(np.int64) - 1, int(dense[-1])
    order = _order(values)
    ordered = values[order]
    new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    out = np.empty(len(values), np.int64)
    out[order] = new
    return out, int(new[-1]) + 1


def _names(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 of the triples that start at ``at``, and how many differ."""
    m = int(s.max()) + 1
    first, below = s[at].astype(np.int64) * m + s[at + 1], m * m
    if m**3 >= 2**62:
        first, below = _ranks(first, below)
    names, different = _ranks(first * m + s[at + 2], below * m)
    return names + 1, different


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes as numbers from 1 without gaps, in the order of the bytes."""
    return np.cumsum(np.bincount(data, minlength=256) > 0, dtype=np.int32)[data]


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of ``s`` (numbers above 0) in order.

    Triples at positions 1 and 2 modulo 3 are sorted and named. While names are not unique, the
    string of names is sorted in the same way. The suffixes at positions 0 modulo 3 are sorted by
    their first number and the rank behind it, and merged.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int32)  # names are fewer than places
    sample = np.concatenate([np.arange(1, n, 3), np.arange(2, n, 3)])
    n_one = len(range(1, n, 3))
    names, different = _names(s, sample)
    if different == len(sample):
        order = np.empty(len(sample), np.int64)
        order[names - 1] = np.arange(len(sample))
    else:
        joined = [np.concatenate([names[:n_one] + 1, [1], names[n_one:] + 1]).astype(np.int32)]
        del names  # rounds below hold their own numbers only
        order = suffix_order(joined.pop())
        order = order[order != n_one]
        order = order - (order > n_one)
    rank = np.zeros(n + 3, np.int32)
    rank[sample[order]] = np.arange(1, len(sample) + 1)

    top, size = len(sample) + 2, int(s.max()) + 1

    def key(at: np.ndarray) -> np.ndarray:
        return s[at].astype(np.int64) * top + rank[at + 1]

    def long_key(at: np.ndarray) -> np.ndarray:
        return (s[at].astype(np.int64) * size + s[at + 1]) * top + rank[at + 2]

    rest = np.arange(0, n, 3)
    own = key(rest)
    by_key = _order(own)
    rest, own = rest[by_key], own[by_key]
    ordered = sample[order]
    ones, twos = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    place = np.searchsorted(key(ones), own)  # ones and twos are in order, so their keys are
    if size**2 * top < 2**63:
        place += np.searchsorted(long_key(twos), long_key(rest))
    else:
        place += _by_pairs(s, rank, twos, rest, size)
    out = np.empty(n, np.int64)
    spots = place + np.arange(len(rest))
    taken = np.zeros(n, bool)
    taken[spots] = True
    out[spots] = rest
    out[~taken] = ordered
    return out


def _by_pairs(s, rank, twos, rest, size) -> np.ndarray:
    """As the search by long keys, for numbers too large to pack: pairs are named first."""
    both = np.concatenate([twos, rest])
    named = _ranks(s[both].astype(np.int64) * size + s[both + 1], size * size)[0]
    keys = named * (int(rank.max()) + 2) + rank[both + 2]
    return np.searchsorted(keys[: len(twos)], keys[len(twos) :])
