"""Brute force over small tables given as lists of tuples."""

from __future__ import annotations

from collections import Counter
from itertools import combinations


def all_sets(width):
    return [c for s in range(1, width + 1) for c in combinations(range(width), s)]


def key_error(rows, combo, nulls_equal=True):
    tuples = [tuple(r[c] for c in combo) for r in rows]
    if not nulls_equal:
        tuples = [t for t in tuples if None not in t]
    return sum(n - 1 for n in Counter(tuples).values())


def minimal_keys(rows, width, tolerance=0, nulls_equal=True):
    keys = {c for c in all_sets(width) if key_error(rows, c, nulls_equal) <= tolerance}
    return {k for k in keys if not any(set(o) < set(k) for o in keys)}


def maximal_nonkeys(rows, width, tolerance=0, nulls_equal=True):
    rest = {c for c in all_sets(width) if key_error(rows, c, nulls_equal) > tolerance}
    return {k for k in rest if not any(set(o) > set(k) for o in rest)}


def minimal_hitting_sets(families, width):
    """Minimal sets inside none of the families' sets."""
    good = {c for c in all_sets(width) if not any(set(c) <= set(f) for f in families)}
    return {k for k in good if not any(set(o) < set(k) for o in good)}


def sets_of(df):
    return {tuple(r.cols) for r in df.select("cols").collect()}
