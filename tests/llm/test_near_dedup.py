"""Near-duplicate groups: shared ids, hot buckets, clashing names."""

import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import near_dedup


def words(seed, n=60):
    return [f"w{k}" for k in np.random.default_rng(seed).integers(0, 10**6, n)]


def test_rows_of_one_id_with_two_texts_link_their_classes(spark):
    a, b = words(1), words(2)
    near = lambda w: w[:-1] + ["other"]
    texts = [(5, a), (5, b), (6, near(a)), (7, near(b)), (8, words(3)), (5, a), (9, b)]
    rows = [(i, " ".join(w)) for i, w in texts]
    found = near_dedup.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.component_id) for r in found} == {(5, 5), (6, 5), (7, 5), (8, 8), (9, 5)}


def test_columns_of_any_name_stay(spark):
    rows = [(1, " ".join(words(1)), 1, 2, "x"), (2, " ".join(words(1)), 1, 2, "y"), (None, None, 3, 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _id int, `a.b` int, kept string")
    left = near_dedup.dedup(docs)
    assert left.columns == docs.columns
    assert {tuple(r) for r in left.collect()} == {rows[0], rows[2]}


def test_hot_bucket_is_dealt_out(spark, monkeypatch):
    """One bucket with two components: its tiles are many groups, and no row holds a set."""
    monkeypatch.setattr(near_dedup, "TILE", 64)
    rng = np.random.default_rng(0)
    n = 1000
    members = spark.createDataFrame([(7, i, 0 if i < 700 else 700) for i in range(n)], "key bigint, id bigint, root bigint")
    tiles = near_dedup._tiles(members)
    assert tiles.columns == ["key", "left", "right", "side", "id", "root"]
    sizes = tiles.groupBy("left", "right").agg(F.count("*").alias("n")).collect()
    assert len(sizes) == 5 * 16 and max(r.n for r in sizes) < 4 * 64
    base = rng.integers(0, 2**16, near_dedup.MINIMA).astype(np.uint16)
    sigs = spark.createDataFrame([(i, base.tobytes(), 50) for i in range(n)], "id bigint, sig binary, n_shingles bigint")
    # Equal signatures share entry 0 first, so the pairs count in a bucket of that number only.
    dealt = near_dedup._members_of_pairs(tiles.withColumn("key", F.lit(64).cast("bigint")).join(sigs, "id"), 80)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "words" not in plan
    assert dealt.select("id").distinct().count() == n
    assert near_dedup._members_of_pairs(tiles.join(sigs, "id"), 80).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert dealt.select(F.spark_partition_id()).distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_chains_of_near_copies(spark):
    """A chain of texts of which only neighbours are alike is one component."""
    base = words(4, 200)
    texts, now = [], list(base)
    for i in range(30):
        texts.append((100 - i, " ".join(now)))
        now[i * 5 : i * 5 + 4] = [f"n{i}{k}" for k in range(4)]
    rows = near_dedup.groups(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in rows} == {71}


def test_two_texts_in_neighbouring_bands_are_linked(spark):
    """Sets of 100 and 83 shingles lie in two bands of size, where neither has another member."""
    rows = []
    for p in range(8):
        text = words(50 + p, 103)
        rows += [(2 * p, " ".join(text)), (2 * p + 1, " ".join(text[:86]))]
    found = near_dedup.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(i, i - i % 2) for i in range(16)}


def test_bounds_lose_no_link():
    rng = np.random.default_rng(3)
    import pyarrow as pa

    sets = [np.unique(rng.integers(0, 2**63, 90_000).astype(np.uint64) << np.uint64(1)) for _ in range(2)]
    for n in (3, 40, 900, 20_000):
        for shared in (0.7, 0.86, 0.89, 0.95):
            a = sets[0][rng.permutation(len(sets[0]))[:n]]
            b = np.unique(np.concatenate([a[: int(n * shared)], sets[1][: n - int(n * shared)]]))
            a = np.unique(a)
            cells = [np.minimum(np.bincount((s >> np.uint64(56)).astype(int), minlength=256), 255) for s in (a, b)]
            rows = pa.table({"cells": [c.astype(np.uint8).tobytes() for c in cells], "n_shingles": [len(a), len(b)]})
            kept = near_dedup._overlap_bound(rows, np.array([[5, 0, 1]]), 80)[0]
            assert kept or not near_dedup.linked(a, b, 80)
            assert not kept or shared > 0.8 or n == 20_000 or n == 3


def test_texts_of_members(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(2000)], "doc_id bigint, text string")
    members = spark.createDataFrame([(i, i) for i in range(0, 2000, 7)], "id bigint, low bigint")
    found = {r.doc_id for r in near_dedup._texts_of(docs, members).collect()}
    assert found == set(range(0, 2000, 7))
    assert near_dedup._texts_of(docs, members.limit(0)).count() == 0


def test_key_filter(spark):
    from keyloom.llm.key_filter import having, lacking

    rows = spark.createDataFrame([*((i, f"t{i}") for i in range(300)), (None, "n"), (7, "again")], "doc_id bigint, row string")
    keys = spark.createDataFrame([(i,) for i in [*range(0, 300, 7), 7, 999, None]], "k bigint")
    held = [r for r in rows.collect() if r.doc_id is not None and r.doc_id % 7 == 0]
    assert sorted(having(rows, "doc_id", keys).collect()) == sorted(held)
    left = lacking(rows, rows.doc_id, keys)
    assert sorted(left.collect(), key=str) == sorted(set(rows.collect()) - set(held), key=str) and left.columns == rows.columns
    assert lacking(rows, rows.doc_id, keys.limit(0)).count() == 302 and having(rows, "doc_id", keys.limit(0)).count() == 0
    # The bitmap is joined below the join by key: Spark must not move the latter to the whole rows.
    for asked in (near_dedup._texts_of(rows.toDF("doc_id", "text"), keys.toDF("low")), left):
        plan = asked._jdf.queryExecution().optimizedPlan().toString().split("\n")
        joins = [line for line in plan if "Join " in line]
        assert any("_bucket" in line for line in joins)
        top = [line for line in joins if "_bucket" not in line]
        assert top and plan.index(top[-1]) < plan.index([line for line in joins if "_bucket" in line][-1])
