"""Cells, clusters and cluster membership: the row-level view of what repeats.

A cluster is named by the smallest row id in it, so ids need no global ranking and are
the same under any partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keyloom.functions import values as V
from keyloom.operators import collations
from keyloom.staging import Stage

# A task is meant to take a SHARE-th of a column's rows; a larger group is dealt to as many tasks as it has
# such parts. At most SHARE groups of a column are larger: the broadcast list is bounded by the schema.
SHARE = 1024
# A group of so few rows is not worth dealing out.
LEAST_ROWS = 10_000


def cells(df: DataFrame, row_id: str, columns: list[str] | None = None) -> DataFrame:
    """``row_id, col_idx, col_name, value``: one record per row and column, as text."""
    columns = columns or [c for c in df.columns if c != row_id]
    df = collations.plain(df.select(*[f"`{c}`" for c in dict.fromkeys([row_id, *columns])]))
    types = {f.name: f.dataType for f in df.schema.fields}
    record = F.array(
        *[
            F.struct(
                F.lit(i).alias("col_idx"),
                F.lit(c).alias("col_name"),
                V.as_text(F.col(f"`{c}`"), types[c]).alias("value"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return df.select(F.col(f"`{row_id}`").alias("row_id"), F.inline(record))


def clusters(cell_rows: DataFrame, nulls_equal: bool = True) -> DataFrame:
    """Values seen more than once: ``col_idx, col_name, value, cluster_id, n``."""
    if not nulls_equal:
        cell_rows = cell_rows.where(F.col("value").isNotNull())
    return (
        cell_rows.groupBy("col_idx", "col_name", "value")
        .agg(F.min("row_id").alias("cluster_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def _label_rows(rows: DataFrame, groups: DataFrame, keys: list[str], scope: list[str], stage: Stage,
                least_rows: int = LEAST_ROWS) -> DataFrame:
    """Equi-join ``rows`` to their group on ``keys`` (null-safe); a large group is dealt to several tasks.

    The groups are written once, and their own counts say how many parts each needs: its rows over the
    rows that a task should take (a ``SHARE``-th of the rows per ``scope``, but at least ``least_rows``).
    Groups of two parts or more, at most ``SHARE`` per ``scope``, are listed by a fixed-width hash and
    broadcast. Their rows get a part from the row id and the group is repeated once per part. The hash
    only places rows; the join itself compares the keys, and both sides consult the same list.
    """
    groups = stage.put(groups.withColumn("fp", F.xxhash64(*keys)), "groups")
    per_task = F.greatest(F.sum("n") / SHARE, F.lit(float(least_rows)))
    totals = groups.groupBy(*scope).agg(per_task.alias("per_task"))
    if scope:
        # one total per column; the clusters themselves must not be shuffled by column
        sized = groups.select(*scope, "fp", "n").join(F.broadcast(totals), scope)
    else:
        sized = groups.select("fp", "n").withColumn("per_task", F.lit(totals.scalar()))
    parts = sized.where("n > per_task").groupBy(*scope, "fp")
    parts = F.broadcast(parts.agg(F.ceil(F.max(F.col("n") / F.col("per_task"))).alias("parts")))

    part = F.pmod(F.xxhash64("row_id"), F.coalesce("parts", F.lit(1).cast("bigint")))
    rows = rows.withColumn("fp", F.xxhash64(*keys)).join(parts, [*scope, "fp"], "left")
    rows = rows.withColumn("salt", part).drop("parts", "fp")
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1).cast("bigint")) - 1)
    groups = groups.join(parts, [*scope, "fp"], "left")
    groups = groups.withColumn("salt", F.explode(copies)).drop("parts", "fp")
    on = F.col("r.salt") == F.col("g.salt")
    for k in keys:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}"))
    return rows.alias("r").join(groups.alias("g"), on)


def membership(cell_rows: DataFrame, nulls_equal: bool = True) -> DataFrame:
    """``col_idx, col_name, row_id, cluster_id`` of every row that shares its value."""
    stage = Stage(cell_rows.sparkSession)
    joined = _label_rows(cell_rows, clusters(cell_rows, nulls_equal), ["col_idx", "value"], ["col_idx"], stage)
    return joined.select("r.col_idx", "r.col_name", "r.row_id", "g.cluster_id")


def clusters_of_combo(df: DataFrame, row_id: str, combo: list[str], nulls_equal: bool = True) -> DataFrame:
    """Clusters of a column set: one aggregate over all its columns, native types kept."""
    rows = df if nulls_equal else V.without_nulls(df, combo)
    return (
        rows.groupBy(*[F.col(f"`{c}`") for c in combo])
        .agg(F.min(f"`{row_id}`").alias("cluster_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def membership_of_combo(df: DataFrame, row_id: str, combo: list[str], nulls_equal: bool = True) -> DataFrame:
    """``row_id, cluster_id`` for a column set."""
    rows = df if nulls_equal else V.without_nulls(df, combo)
    rows = rows.select(
        F.col(f"`{row_id}`").alias("row_id"),
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(combo)],
    )
    keys = [f"k{i}" for i in range(len(combo))]
    joined = _label_rows(rows, clusters_of_combo(rows, "row_id", keys), keys, [], Stage(df.sparkSession))
    return joined.select("r.row_id", "g.cluster_id")


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows alone in either index are absent from it, so the inner join drops them."""
    return a.select("row_id", F.col("cluster_id").alias("cluster_a")).join(
        b.select("row_id", F.col("cluster_id").alias("cluster_b")), "row_id"
    )


def _joint(both: DataFrame) -> DataFrame:
    return (
        both.groupBy("cluster_a", "cluster_b")
        .agg(F.min("row_id").alias("cluster_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Clusters of two memberships taken together: ``cluster_a, cluster_b, cluster_id, n``."""
    return _joint(_both(a, b))


def intersect_membership(a: DataFrame, b: DataFrame) -> DataFrame:
    """``row_id, cluster_id`` of the intersection, to intersect further. The two indexes are joined once."""
    stage = Stage(a.sparkSession)
    both = stage.put(_both(a, b), "both")
    joined = _label_rows(both, _joint(both), ["cluster_a", "cluster_b"], [], stage)
    return joined.select("r.row_id", "g.cluster_id")


def same_clusters(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ``n_a, n_b`` (rows in clusters), ``same_signature, n_other, same``: whether two given
    memberships split the rows into the same clusters.

    A cluster is named by its smallest row, so equal partitions have equal memberships, row by row.
    The signatures (sum and xor of a hash over row and cluster) need no order and no shuffle of rows;
    the full outer join behind them is exact, and counts the rows that lie in other clusters.
    """
    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("row_id", F.col("cluster_id").alias(name))

    def signature(rows: DataFrame, name: str) -> DataFrame:
        mark = F.xxhash64("row_id", "cluster_id")
        return rows.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(mark.cast("decimal(38,0)")).alias("total"),
            F.bit_xor(mark).alias("mixed"),
        ).select(F.lit(1).alias("one"), F.struct("n", "total", "mixed").alias(name))

    other = (
        side(a, "x").join(side(b, "y"), "row_id", "full").where(~F.col("x").eqNullSafe(F.col("y")))
        .agg(F.count(F.lit(1)).alias("n_other"), F.lit(1).alias("one"))
    )
    both = signature(a, "s").join(signature(b, "t"), "one").join(other, "one")
    return both.select(
        F.col("s.n").alias("n_a"),
        F.col("t.n").alias("n_b"),
        F.col("s").eqNullSafe(F.col("t")).alias("same_signature"),
        "n_other",
        (F.col("n_other") == 0).alias("same"),
    )


def _scope(member_rows: DataFrame) -> list[str]:
    return [c for c in ("col_idx", "col_name", "cluster_id") if c in member_rows.columns]


def cluster_members(member_rows: DataFrame) -> DataFrame:
    """Report of whole clusters in long form, one row per member, in order.

    Rows are dealt out by ranges that end in the row id, so a hot cluster spreads over many tasks.
    """
    order = [*_scope(member_rows), "row_id"]
    return member_rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)


def cluster_rows(member_rows: DataFrame, show: int | None = None) -> DataFrame:
    """Report: each cluster with its row ids, or with its first ``show`` ones if asked for.

    The rank limit is applied before the shuffle (Spark's window group limit), so a
    cluster of any size sends at most ``show`` rows per input split. Without a limit a cluster is
    one row, however large; ``cluster_members`` has the same in long form.
    """
    scope = _scope(member_rows)
    if show is not None:
        ranked = F.row_number().over(W.partitionBy(*scope).orderBy("row_id"))
        member_rows = member_rows.withColumn("rank", ranked).where(F.col("rank") <= show)
    return member_rows.groupBy(*scope).agg(F.sort_array(F.collect_list("row_id")).alias("rows"))
