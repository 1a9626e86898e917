"""Connected components by alternating star contractions, as joins over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.staging import Stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have a < b."""
    low = edges.groupBy("b").agg(F.min("a").alias("low"))
    moved = edges.join(low, "b").where("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return moved.unionAll(low.select(F.col("low").alias("a"), "b")).distinct()


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """node, root for every node of an edge (a, b), a < b, that is not the smallest of its
    component; root is that smallest. The edges are written once a round; rounds follow the
    logarithm of the longest path."""
    mark = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))]
    now = stage.put(edges.select("a", "b").distinct(), "edges")
    before = None
    while True:
        state = tuple(now.agg(*mark).first())
        if state == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = state
        now = stage.put(_small_star(_large_star(now)), "edges")
