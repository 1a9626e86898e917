"""Minimal hitting sets as a frame computation.

A candidate key must leave every known non-key: it has to contain a column outside each
of them. The minimal such sets are the minimal hitting sets of the non-keys' complements
("holes"). They are grown one column per step, all at once, beside their *critical lists*: a row
for each set and each hole that the set misses or hits with one column only. Those rows decide
everything, and they are all a larger set needs:

* a set that misses no hole is finished;
* any other is extended by each column of one hole that it misses (the smallest, to branch
  least), and the new column turns rows of missed holes into hits, or drops rows hit twice;
* a set stays only while each of its columns is the only hit of some hole. No superset of a set
  that fails this can be minimal.

So holes are joined with sets once, at the start; a step is one equi-join of the rows with the
extensions of their own set. The number of steps is the size of the largest minimal set, not the
number of non-keys. Rows stay in long form: no set's list is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions import colsets as cs
from keyloom.operators import combos as C
from keyloom.staging import Stage


def first_lists(start: DataFrame, nonkeys: DataFrame, width: int) -> DataFrame:
    """``combo, cols, out, hit``: for each set the holes it misses (``hit`` null) or hits with one column.

    These are the holes of the non-keys that hold the set but for at most one column, so the rest of the
    set is looked up. A set of one column has no rest and meets every hole. The empty set is a non-key.
    """
    tops = nonkeys.select("cols")
    none = start.sparkSession.range(1).select(F.array().cast("array<int>").alias("cols"))
    everyone = F.transform(cs.universe(width), lambda c: F.concat(F.lit("only "), c.cast("string")))
    holes = tops.unionByName(none).select(
        F.col("cols").alias("top"),
        F.array_sort(F.array_except(cs.universe(width), F.col("cols"))).alias("out"),
        F.explode(F.concat(C.all_pairs(F.col("cols")), everyone)).alias("key"),
    )
    parts = start.select("combo", F.col("cols").alias("whole"), F.explode("cols").alias("x"))
    rests = C.with_own_pair(parts.withColumn("cols", cs.drop(F.col("whole"), F.col("x"))), tops)
    alone = F.concat(F.lit("only "), F.col("x").cast("string"))
    asked = rests.withColumn("key", F.when(F.size("whole") == 1, alone).otherwise(F.col("own_pair")))
    missed = F.array_contains("top", F.col("x"))
    return (
        asked.join(holes, "key")
        .where(cs.is_subset(F.col("cols"), F.col("top")) & (~missed | (F.col("x") == F.col("whole")[0])))
        .select("combo", F.col("whole").alias("cols"), "out", F.when(~missed, F.col("x")).alias("hit"))
    )


def needed_sets(lists: DataFrame) -> DataFrame:
    """``combo, cols, hole``: the sets whose columns are all needed, with their smallest missed hole, if any."""
    hole = F.when(F.col("hit").isNull(), F.struct(F.size("out").alias("s"), "out"))
    return (
        lists.groupBy("combo", "cols")
        .agg(F.min(hole).alias("m"), F.size(F.collect_set("hit")).alias("needed"))
        .where(F.col("needed") == F.size("cols"))
        .select("combo", "cols", F.col("m.out").alias("hole"))
    )


def next_lists(lists: DataFrame, open_sets: DataFrame) -> DataFrame:
    """The rows of all sets with one column more. Parents of one set have the same rows for it, so one
    of them hands its own down."""
    grown = open_sets.select("combo", "cols", F.explode("hole").alias("x")).select(
        F.col("combo").alias("parent"), cs.add(F.col("cols"), F.col("x")).alias("larger"), "x"
    )
    heirs = (
        grown.groupBy("larger")
        .agg(F.min(F.struct("parent", "x")).alias("by"))
        .select("larger", F.col("by.parent").alias("combo"), F.col("by.x").alias("x"))
    )
    has = F.array_contains("out", F.col("x"))
    return (
        lists.join(heirs, "combo")
        .where(F.col("hit").isNull() | ~has)
        .select(
            cs.combo_text(F.col("larger")).alias("combo"),
            F.col("larger").alias("cols"),
            "out",
            F.coalesce("hit", F.when(has, F.col("x"))).alias("hit"),
        )
    )


def grow(start: DataFrame, nonkeys: DataFrame, width: int, stage: Stage, max_size: int | None = None) -> DataFrame:
    """All minimal hitting sets that contain a set of ``start`` (``combo, cols``)."""
    is_open = F.col("hole").isNotNull()
    if max_size is not None:
        is_open = is_open & (F.size("cols") < max_size)
    finished = []
    lists = stage.put(first_lists(start, nonkeys, width), "lists")
    while True:
        level, n_open = stage.put_counted(needed_sets(lists), "grow", is_open)
        finished.append(level.where(F.col("hole").isNull()).select("combo", "cols"))
        if not n_open:
            break
        lists = stage.put(next_lists(lists, level.where(is_open)), "lists")
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(["combo"])


def single_sets(spark, width: int) -> DataFrame:
    """Every column by itself: what must be hit when only the empty set is known to fail."""
    return C.combo_frame(spark, [(c,) for c in range(width)]).select("combo", "cols")


def hitting_sets(nonkeys: DataFrame, width: int, stage: Stage | None = None, max_size: int | None = None) -> DataFrame:
    """Minimal sets of columns that are inside none of ``nonkeys``.

    By duality: from the maximal non-keys this gives the minimal keys, and from the
    complements of the minimal keys it gives the complements of the maximal non-keys.
    """
    spark = nonkeys.sparkSession
    stage = stage or Stage(spark)
    nonkeys = C.maximal(cs.describe(nonkeys.select("cols")))
    nonkeys = stage.put(nonkeys, "nonkeys")
    out = grow(single_sets(spark, width), nonkeys, width, stage, max_size)
    return cs.describe(out.select("cols"))
