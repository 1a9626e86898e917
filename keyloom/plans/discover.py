"""The user-facing discovery calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import colsets as cs
from keyloom.operators import combos as C
from keyloom.plans import evidence, levelwise
from keyloom.plans.encode import encode
from keyloom.staging import Stage


def _named(sets: DataFrame, names: Sequence[str], *extra) -> DataFrame:
    labels = F.array(*[F.lit(n) for n in names])
    named = F.transform("cols", lambda i: F.get(labels, i))
    return cs.describe(sets, named.alias("names"), *extra)


def _columns(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    if columns is None:
        return df
    if not columns:
        raise ValueError("columns must name at least one column")
    return df.select(*[F.col(f"`{c}`") for c in columns])


METHODS = ("evidence", "levels")


def _check_method(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")


def verdicts(df: DataFrame, tolerance: int = 0, nulls_equal: bool = True,
             columns: Sequence[str] | None = None, max_size: int | None = None,
             use_bounds: bool = False, exclude: Column | None = None) -> DataFrame:
    """Every combo that had to be decided, with its exact key error.

    A superset of a key listed here is a key; a subset of a non-key is a non-key.
    ``use_bounds`` skips counting combos with too few possible values to be a key.
    """
    df = _columns(df, columns)
    stage = Stage(df.sparkSession)
    codes = encode(df, stage, nulls_equal)
    found = levelwise.run(codes, stage, tolerance, max_size, use_bounds, exclude)
    return _named(found, df.columns, "key_error", "is_key", "how")


def minimal_keys(df: DataFrame, tolerance: int = 0, nulls_equal: bool = True,
                 columns: Sequence[str] | None = None, max_size: int | None = None,
                 exclude: Column | None = None, method: str = "evidence") -> DataFrame:
    """Minimal sets of columns that identify every row but at most ``tolerance``.

    ``combo, cols, mask, size, names, key_error``. ``exclude`` is a condition on
    ``combo, cols, mask, size`` for sets not to consider; it must also hold for every
    superset of a set it holds for. ``method`` is ``"evidence"``, or ``"levels"`` to count
    every set below the keys; both give the same keys.
    """
    df = _columns(df, columns)
    _check_method(method)
    stage = Stage(df.sparkSession)
    codes = encode(df, stage, nulls_equal)
    if not codes.n_rows:
        return _named(C.combo_frame(df.sparkSession, []), df.columns,
                      F.lit(0).cast("bigint").alias("key_error"))
    if method == "evidence":
        found = evidence.run(codes, stage, max_size, exclude, tolerance=tolerance).keys
    else:
        found = levelwise.run(codes, stage, tolerance, max_size, True, exclude).where("is_key")
    return _named(found, df.columns, "key_error")


def _within(sets: DataFrame, max_size: int | None, exclude: Column | None, stage: Stage) -> DataFrame:
    """The largest subsets of ``sets`` that have at most ``max_size`` columns and are not excluded."""
    if max_size is not None:
        cut = C.combos_of_size(sets.where(F.col("size") > max_size), max_size)
        sets = C.union(sets.where(F.col("size") <= max_size), cut).where(F.col("size") > 0)
    if exclude is None:
        return sets if max_size is None else C.maximal(stage.put(sets, "within"))
    out = F.coalesce(exclude, F.lit(False))
    level, n_out = stage.put_counted(sets.select("combo", "cols", "mask", "size"), "within", out)
    kept = level.where(~out)
    while n_out:  # one column less each time
        level, n_out = stage.put_counted(C.direct_subsets(level.where(out)), "within", out)
        kept = kept.unionByName(level.where(~out))
    return C.maximal(kept)


def maximal_nonkeys(df: DataFrame, tolerance: int = 0, nulls_equal: bool = True,
                    columns: Sequence[str] | None = None, max_size: int | None = None,
                    exclude: Column | None = None, method: str = "evidence") -> DataFrame:
    """Largest sets of columns that still leave more than ``tolerance`` rows unidentified.

    With ``max_size`` or ``exclude`` (as in :func:`minimal_keys`), the largest among the sets that they
    allow. The search itself is complete: the allowed sets are cut from the whole border.
    """
    _check_method(method)
    df = _columns(df, columns)
    stage = Stage(df.sparkSession)
    codes = encode(df, stage, nulls_equal)
    if not codes.n_rows:
        return _named(C.combo_frame(df.sparkSession, []), df.columns)
    if method == "evidence":
        found = evidence.run(codes, stage, tolerance=tolerance).nonkeys
    else:
        found = C.maximal(levelwise.run(codes, stage, tolerance).where("not is_key"))
    if max_size is not None or exclude is not None:
        found = _within(cs.describe(found), max_size, exclude, stage)
    return _named(found, df.columns)


def key_count(df: DataFrame, **options) -> DataFrame:
    """Number of minimal keys, single columns included."""
    return minimal_keys(df, **options).agg(F.count(F.lit(1)).alias("n_keys"))
