"""Operators over frames of column sets.

Every frame has ``cols array<int>`` (sorted); results carry ``combo, cols, mask, size``.

Containment is an equi-join on two members at once: each superset is listed under every pair of
its members, and a subset looks it up under its own two rarest ones, rare among the supersets.
Sets that tie choose by a hash of set and member, so not all sets meet under the same pair; the
rest of the set is a residual condition. Sets of one column look up that column.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import colsets as cs


def combo_frame(spark: SparkSession, sets) -> DataFrame:
    """A frame from a short list of position tuples (one batch, one round's evidence)."""
    texts = [",".join(str(c) for c in sorted(s)) for s in sets]
    table = pa.table({"combo": pa.array(texts, pa.string())})
    return cs.describe(
        spark.createDataFrame(table).select(cs.combo_cols(F.col("combo")).alias("cols"))
    )


def _distinct(df: DataFrame) -> DataFrame:
    return cs.describe(df).dropDuplicates(["combo"])


# --- generation -------------------------------------------------------------------


def _grow(df: DataFrame, pool: str, times: int) -> DataFrame:
    """Extend ``cols`` by ``times`` members of ``pool``, each above the one before it."""
    for _ in range(times):
        above = F.filter(pool, lambda x: x > F.coalesce(F.array_max("picked"), F.lit(-1)))
        df = df.select("*", F.explode(above).alias("next")).select(
            *[c for c in df.columns if c != "picked"],
            F.array_append("picked", F.col("next")).alias("picked"),
        )
    return df


def combos_of_size(sets: DataFrame, n: int) -> DataFrame:
    """All n-column subsets of each given set."""
    base = sets.select(
        F.array_sort("cols").alias("pool"), F.array().cast("array<int>").alias("picked")
    )
    return _distinct(_grow(base, "pool", n).select(F.col("picked").alias("cols")))


def combos_containing(sets: DataFrame, required, n: int) -> DataFrame:
    """All n-column subsets of each set that contain ``required``; none if it does not fit."""
    required = sorted(required)
    if n < len(required):
        return combos_of_size(sets, 1).limit(0)
    need = F.array(*[F.lit(c) for c in required]).cast("array<int>")
    base = sets.where(cs.is_subset(need, F.col("cols"))).select(
        F.array_sort(F.array_except("cols", need)).alias("pool"),
        F.array().cast("array<int>").alias("picked"),
    )
    grown = _grow(base, "pool", n - len(required))
    return _distinct(grown.select(cs.union(F.col("picked"), need).alias("cols")))


def direct_supersets(sets: DataFrame, bound: Column) -> DataFrame:
    """Each set with one more column of ``bound``."""
    return _distinct(
        sets.select("cols", F.explode(F.array_except(bound, F.col("cols"))).alias("x")).select(
            cs.add(F.col("cols"), F.col("x")).alias("cols")
        )
    )


def direct_subsets(sets: DataFrame, keep=()) -> DataFrame:
    """Each set with one column less; the columns of ``keep`` stay.

    A set that does not properly contain ``keep`` has no such subset. The empty set
    is not a combo.
    """
    kept = F.array(*[F.lit(c) for c in sorted(keep)]).cast("array<int>")
    rows = sets.where(cs.is_subset(kept, F.col("cols")) & (F.size("cols") > 1))
    return _distinct(
        rows.select("cols", F.explode(F.array_except("cols", kept)).alias("x")).select(
            cs.drop(F.col("cols"), F.col("x")).alias("cols")
        )
    )


def all_subsets(sets: DataFrame, width: int, with_empty: bool = False) -> DataFrame:
    """Every subset of each set, itself included. For reports only: the count is 2^size."""
    rows = sets.select("cols", F.array().cast("array<int>").alias("picked"))
    for i in range(width):
        grown = F.array(F.col("picked"), F.concat("picked", F.slice("cols", i + 1, 1)))
        rows = rows.select(
            "cols",
            F.explode(
                F.when(F.size("cols") > i, grown).otherwise(F.array(F.col("picked")))
            ).alias("picked"),
        )
    rows = rows.select(F.col("picked").alias("cols"))
    return _distinct(rows if with_empty else rows.where(F.size("cols") > 0))


def all_supersets(sets: DataFrame, width: int) -> DataFrame:
    """Every superset within ``width`` columns, itself included. For reports only."""
    rows = sets.select("cols")
    for i in range(width):
        grown = F.array(F.col("cols"), cs.add(F.col("cols"), F.lit(i)))
        rows = rows.select(
            F.explode(
                F.when(F.array_contains("cols", i), F.array(F.col("cols"))).otherwise(grown)
            ).alias("cols")
        )
    return _distinct(rows)


def members(sets: DataFrame, width: int) -> DataFrame:
    """One row per (set, column of the table) with the membership flag."""
    return cs.describe(sets).select(
        "combo", "size", F.explode(cs.universe(width)).alias("col_idx"), "cols"
    ).select(
        "combo",
        "size",
        "col_idx",
        F.array_contains("cols", F.col("col_idx")).alias("is_member"),
    )


def complement(sets: DataFrame, universe: Column) -> DataFrame:
    """``cols`` replaced by the columns that are not in it."""
    return _distinct(
        sets.select(F.array_sort(F.array_except(universe, F.col("cols"))).alias("cols"))
    )


# --- containment ------------------------------------------------------------------


def _rarity(tops: DataFrame) -> Column:
    """Map of each column to the number of sets that have it: one small row, asked when needed."""
    counts = tops.select(F.explode("cols").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("m"))
    return listed.scalar()


def with_own_pair(sets: DataFrame, tops: DataFrame) -> DataFrame:
    """``own_pair``: the two members of each set that are rarest among ``tops``, as a text; an only one
    twice, none for the empty set."""
    rows = sets.withColumn("rarity", _rarity(tops))
    pair = _own_pair(F.col("cols"), F.col("rarity"))
    return rows.withColumn("own_pair", F.when(F.size("cols") > 0, pair)).drop("rarity")


def _own_pair(cols: Column, rarity: Column) -> Column:
    ranked = F.array_sort(
        F.transform(cols, lambda c: F.struct(
            F.coalesce(rarity[c], F.lit(0)).alias("n"), F.xxhash64(cs.combo_text(cols), c).alias("h"), c.alias("c")))
    )
    a, b = F.get(ranked, 0)["c"], F.coalesce(F.get(ranked, 1)["c"], F.get(ranked, 0)["c"])
    return F.concat_ws(",", F.least(a, b), F.greatest(a, b))


def all_pairs(cols: Column) -> Column:
    """Every pair of members of a set, and every member twice, as texts."""
    return F.flatten(
        F.transform(cols, lambda a: F.transform(F.filter(cols, lambda b: b >= a), lambda b: F.concat_ws(",", a, b)))
    )


def below(sets: DataFrame, tops: DataFrame, how: str, proper: bool = False) -> DataFrame:
    """Sets that are (``left_semi``) or are not (``left_anti``) inside one of ``tops``."""
    top = tops.select(F.col("cols").alias("top"), F.explode(all_pairs(F.col("cols"))).alias("pair"))
    inside = (F.col("own_pair") == F.col("pair")) & cs.is_subset(F.col("cols"), F.col("top"))
    if proper:
        inside = inside & (F.size("top") > F.size("cols"))
    return with_own_pair(sets, tops).join(top, inside, how).drop("own_pair")


def above(sets: DataFrame, bases: DataFrame, how: str, proper: bool = False) -> DataFrame:
    """Sets that do or do not contain one of ``bases``."""
    base = with_own_pair(bases, sets).select(F.col("cols").alias("base"), "own_pair")
    inside = (F.col("pair") == F.col("own_pair")) & cs.is_subset(F.col("base"), F.col("cols"))
    if proper:
        inside = inside & (F.size("cols") > F.size("base"))
    hits = (
        sets.select("combo", "cols", F.explode(all_pairs(F.col("cols"))).alias("pair"))
        .join(base, inside, "left_semi")
        .select("combo")
        .distinct()
    )
    return sets.join(hits, "combo", how)


def undecided(candidates: DataFrame, keys: DataFrame, nonkeys: DataFrame) -> DataFrame:
    """Candidates that neither contain a known key nor lie inside a known non-key."""
    return below(above(candidates, keys, "left_anti"), nonkeys, "left_anti")


def known(candidates: DataFrame, classified: DataFrame) -> DataFrame:
    """Candidates that are literally among the classified combos."""
    return candidates.join(classified.select("combo"), "combo", "left_semi")


def minimal(sets: DataFrame) -> DataFrame:
    """Drop every set that properly contains another one."""
    sets = sets.dropDuplicates(["combo"])
    return above(sets, sets, "left_anti", proper=True)


def maximal(sets: DataFrame) -> DataFrame:
    """Drop every set that lies properly inside another one."""
    sets = sets.dropDuplicates(["combo"])
    return below(sets, sets, "left_anti", proper=True)


# --- algebra and order ------------------------------------------------------------


def combine(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Union, intersection and difference of two set columns."""
    return pairs.select(
        "*",
        cs.union(F.col(a), F.col(b)).alias("union_cols"),
        F.array_sort(F.array_intersect(a, b)).alias("common_cols"),
        F.array_sort(F.array_except(a, b)).alias("only_cols"),
    )


def overlapping(a: DataFrame, b: DataFrame, at_least: int = 1) -> DataFrame:
    """Pairs of sets that share ``at_least`` columns or more: ``a_cols, b_cols``, each pair once.

    Members are ranked by how few sets have them. Two sets with that much in common share a member
    among all but the last ``at_least - 1`` of each, so only those are joined, and a pair is taken
    where its first common member meets. Sets that are too small take no part.
    """
    if at_least < 1:
        raise ValueError("sets that share nothing are not found by a join")
    sets = {side: df.select("cols").dropDuplicates(["cols"]) for side, df in (("a", a), ("b", b))}
    rarity = _rarity(sets["a"].unionAll(sets["b"]))

    def listed(side: str) -> DataFrame:
        ranked = F.transform(
            F.array_sort(F.transform("cols", lambda c: F.struct(F.col("rarity")[c].alias("n"), c.alias("c")))),
            lambda x: x["c"],
        )
        rows = sets[side].where(F.size("cols") >= at_least).withColumn("rarity", rarity)
        rows = rows.select(F.col("cols").alias(f"{side}_cols"), ranked.alias(f"{side}_ranked"))
        first = F.slice(f"{side}_ranked", F.lit(1), F.size(f"{side}_ranked") - (at_least - 1))
        return rows.withColumn("pivot", F.explode(first))

    common = F.array_intersect("a_ranked", "b_ranked")
    pairs = listed("a").join(listed("b"), "pivot")
    return pairs.where((F.size(common) >= at_least) & (common[0] == F.col("pivot"))).select("a_cols", "b_cols")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return _distinct(a.select("cols").unionByName(b.select("cols")))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sets of ``a`` that are not in ``b``, every match dropped."""
    return a.join(b.select("combo"), "combo", "left_anti").dropDuplicates(["combo"])


def canonical_order(sets: DataFrame) -> DataFrame:
    """By size, then by position list."""
    return sets.orderBy(F.size("cols"), "cols")
