"""Cells, clusters and membership."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from keyloom.operators import cells as L
from keyloom.operators import keyerror as K
from keyloom.staging import Stage


def column(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id bigint, v string")


def test_worked_example(spark):
    """Values a a b c b c give the clusters (0,1) (2,4) (3,5)."""
    # The worked example of the definitions, rows and clusters as given there.
    cells = L.cells(column(spark, "aabcbc"), "id")
    shown = L.cluster_rows(L.membership(cells)).collect()
    assert sorted(tuple(r.rows) for r in shown) == [(0, 1), (2, 4), (3, 5)]
    member = {r.row_id: r.cluster_id for r in L.membership(cells).collect()}
    assert member == {0: 0, 1: 0, 2: 2, 3: 3, 4: 2, 5: 3}
    error = K.single_columns(column(spark, "aabcbc").select("v")).collect()[0]
    assert (error.n_clusters, error.key_error) == (3, 3)


def test_singletons_and_nulls(spark):
    cells = L.cells(column(spark, ["a", "b", None, None, "b"]), "id")
    assert {(r.value, r.cluster_id, r.n) for r in L.clusters(cells).collect()} == {("b", 1, 2), (None, 2, 2)}
    assert {r.row_id for r in L.membership(cells).collect()} == {1, 2, 3, 4}
    assert {r.row_id for r in L.membership(cells, nulls_equal=False).collect()} == {1, 4}


def skewed(spark, n=2000):
    rng = random.Random(1)
    rows = [
        (i, "hot" if rng.random() < 0.4 else f"v{rng.randrange(300)}", rng.randrange(4)) for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "id bigint, x string, y int")


def groups(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r[0])
    return {r: min(ids) for ids in out.values() if len(ids) > 1 for r in ids}


def test_hot_value_is_split(spark):
    rows, df = skewed(spark)
    got = {(r.col_idx, r.row_id): r.cluster_id for r in L.membership(L.cells(df, "id")).collect()}
    want = {(0, k): v for k, v in groups(rows, lambda r: r[1]).items()}
    want |= {(1, k): v for k, v in groups(rows, lambda r: r[2]).items()}
    assert got == want
    joined = L.membership(L.cells(df, "id"))
    assert joined.count() == len(want)


def test_intersection_equals_combo(spark):
    rows, df = skewed(spark)
    cells = L.cells(df, "id")
    member = L.membership(cells)
    a, b = member.where("col_idx = 0"), member.where("col_idx = 1")
    want = groups(rows, lambda r: (r[1], r[2]))
    assert {r.row_id: r.cluster_id for r in L.intersect_membership(a, b).collect()} == want
    assert {r.row_id: r.cluster_id for r in L.membership_of_combo(df, "id", ["x", "y"]).collect()} == want
    sizes = {r.cluster_id: r.n for r in L.intersect(a, b).collect()}
    assert {r.cluster_id: r.n for r in L.clusters_of_combo(df, "id", ["x", "y"]).collect()} == sizes


def test_combo_with_distinct_nulls(spark):
    df = spark.createDataFrame([(0, None, 1), (1, None, 1), (2, 5, 1), (3, 5, 1)], "id int, x int, y int")
    assert {r.cluster_id for r in L.clusters_of_combo(df, "id", ["x", "y"], nulls_equal=False).collect()} == {2}
    assert L.membership_of_combo(df, "id", ["x", "y"]).count() == 4


def test_report_limit(spark):
    shown = L.cluster_rows(L.membership(L.cells(column(spark, "a" * 50), "id")), show=3).collect()
    assert [r.rows for r in shown] == [[0, 1, 2]]


def test_equivalent_columns(spark):
    rows = [(i % 7, f"n{i % 7}", i % 5, i) for i in range(70)]
    df = spark.createDataFrame(rows, "a int, b string, c int, d int")
    assert [(r.a_name, r.b_name) for r in K.equivalent_columns(df).collect()] == [("a", "b")]
    assert K.equivalent_columns(df.select("a", "c")).count() == 0


def test_text_of_values(spark):
    df = spark.sql("SELECT 1L AS id, -0.0D AS z, X'0aff' AS b, array(1, 2) AS l")
    got = {r.col_name: r.value for r in L.cells(df, "id").collect()}
    assert got == {"z": "0.0", "b": "0AFF", "l": "[1,2]"}


def test_single_column_profile(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "k int, v string")
    assert [r.col_name for r in K.unique_columns(df).collect()] == ["k"]
    row = K.nonkey_columns(df).collect()[0]
    assert (row.combo, row.mask) == ("1", 2)
    assert K.row_count(df).collect()[0].n_rows == 3
    assert K.with_verdict(K.key_errors(df, [["v"]]), 1).select(F.bool_and("is_key")).collect()[0][0]


def test_nan_is_a_value_and_empty_tables_have_no_errors(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, nan, 1), (1, nan, 1), (2, None, 1)], "id int, a double, b int")
    assert [(r.cluster_id, r.n) for r in L.clusters_of_combo(df, "id", ["a"], nulls_equal=False).collect()] == [(0, 2)]
    assert L.membership_of_combo(df, "id", ["a", "b"], nulls_equal=False).count() == 2
    assert K.key_errors(df.select("a", "b"), [[0]], nulls_equal=False).first().key_error == 1
    for equal in (True, False):
        assert K.key_errors(df.select("a", "b").limit(0), [[0]], nulls_equal=equal).collect() == []


def test_wide_null_distinct_combo_ends(spark):
    wide = spark.createDataFrame([tuple(range(64)), tuple(range(64))], [f"c{i}" for i in range(64)])
    assert K.key_errors(wide, [list(range(64))], nulls_equal=False).first().key_error == 1


def test_whole_clusters(spark):
    df = spark.range(1000).select("id", F.lit("hot").alias("v"), (F.col("id") % 500).alias("w"))
    members = L.membership(L.cells(df, "id"))
    rows = {(r.col_idx, r.cluster_id): r.rows for r in L.cluster_rows(members).collect()}
    assert rows[0, 0] == list(range(1000)) and rows[1, 7] == [7, 507]
    long = [(r.col_idx, r.cluster_id, r.row_id) for r in L.cluster_members(members).collect()]
    assert long == sorted((i, c, r) for (i, c), own in rows.items() for r in own)


def test_a_value_of_a_hundredth_of_the_rows_is_dealt_out(spark):
    rows = spark.range(20_000).select(F.col("id").alias("row_id"), (F.col("id") % 100).alias("v"))
    groups = L.clusters_of_combo(rows, "row_id", ["v"])
    dealt = L._label_rows(rows, groups, ["v"], [], Stage(spark), least_rows=25)
    got = dealt.groupBy("g.v").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("r.row_id").alias("ids"), F.countDistinct("r.salt").alias("parts"),
        F.max("g.cluster_id").alias("first"),
    ).collect()
    assert len(got) == 100
    assert all((r.n, r.ids, r.parts, r.first) == (200, 200, 8, r.v) for r in got)


def test_parts_follow_the_rows_of_a_group(spark):
    size = F.when(F.col("id") < 6_000, 0).when(F.col("id") < 6_500, 1).otherwise(F.col("id"))
    rows = spark.range(9_000).select(F.col("id").alias("row_id"), F.nullif(size, F.lit(1)).alias("v"))
    groups = L.clusters_of_combo(rows, "row_id", ["v"])
    dealt = L._label_rows(rows, groups, ["v"], [], Stage(spark), least_rows=100)
    got = {r.v: (r.n, r.parts) for r in dealt.groupBy("g.v").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("r.salt").alias("parts")).collect()}
    assert got == {0: (6_000, 60), None: (500, 5)}


def test_clusters_are_found_once(spark, tmp_path):
    """The source is read once for the groups and once for the labels, and the groups are not found again."""
    def read_in(df, what):
        return df._jdf.queryExecution().optimizedPlan().toString().count(what)

    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") % 7).alias("v"), (F.col("id") % 3).alias("w")).write.parquet(path)
    df = spark.read.parquet(path)
    one = L.membership(L.cells(df, "id"))
    two = [L.membership_of_combo(df, "id", [c]) for c in ("v", "w")]
    for m in (one, *two):
        assert read_in(m, "Relation [id#") == 1
    both = L.intersect_membership(*two)
    assert read_in(both, "Relation [id#") == 0
    assert {r.row_id: r.cluster_id for r in both.collect()} == {i: i % 21 for i in range(100)}
