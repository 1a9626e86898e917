"""Column expressions over column sets.

A column set ("combo") travels as ``cols``, a sorted ``array<int>`` of 0-based
column positions. Arrays keep the expressions valid for tables of any width;
``mask`` is a convenience for tables of at most 63 columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK_BITS = 63


def combo_text(cols: Column) -> Column:
    """``[0, 3]`` -> ``'0,3'``: the equi-join key of a combo."""
    return F.array_join(cols.cast("array<string>"), ",")


def combo_cols(text: Column) -> Column:
    """Inverse of :func:`combo_text`; the empty text is the empty set."""
    return F.when(text == "", F.array().cast("array<int>")).otherwise(
        F.split(text, ",").cast("array<int>")
    )


def combo_mask(cols: Column) -> Column:
    """Sum of ``2^position``; null when a position does not fit a BIGINT."""
    bits = F.aggregate(
        cols,
        F.lit(0).cast("bigint"),
        lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), c)),
    )
    return F.when(F.coalesce(F.array_max(cols), F.lit(0)) < MASK_BITS, bits)


def is_subset(small: Column, big: Column) -> Column:
    """Every position of ``small`` is in ``big`` (equality included)."""
    return F.size(F.array_except(small, big)) == 0


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def add(cols: Column, position: Column) -> Column:
    return F.array_sort(F.array_append(cols, position))


def drop(cols: Column, position: Column) -> Column:
    return F.array_remove(cols, position)


def universe(width: int) -> Column:
    """All positions of a ``width``-column table."""
    return F.expr(f"sequence(0, {width - 1})") if width else F.array().cast("array<int>")


def describe(df: DataFrame, *extra: str | Column) -> DataFrame:
    """``combo, cols, mask, size`` derived from ``cols``, then the extra columns."""
    return df.select(
        combo_text(F.col("cols")).alias("combo"),
        "cols",
        combo_mask(F.col("cols")).alias("mask"),
        F.size("cols").alias("size"),
        *extra,
    )
