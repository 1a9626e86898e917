"""Tests of many column sets over one shuffle of a large table's rows."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.operators import agreement as A
from keyloom.operators import keyerror as K
from keyloom.plans import evidence
from keyloom.plans.encode import encode
from keyloom.staging import Stage

SETS = [c for n in (1, 2, 3, 4) for c in combinations(range(5), n)]


def random_rows(seed, n=600):
    rng = np.random.default_rng(seed)
    pick = lambda k, null: [None if rng.random() < null else int(x) for x in rng.integers(0, k, n)]
    hot = [0 if rng.random() < 0.3 else x for x in pick(90, 0.1)]
    return list(zip(pick(80, 0.05), hot, pick(3, 0.3), [x and f"t{x}" for x in pick(40, 0.1)], pick(300, 0)))


def repeating(rows, nulls_equal):
    out = set()
    for combo in SETS:
        keys = [tuple(r[c] for c in combo) for r in rows]
        keys = keys if nulls_equal else [k for k in keys if None not in k]
        if len(set(keys)) < len(keys):
            out.add(combo)
    return out


@pytest.mark.parametrize("nulls_equal", [True, False])
def test_dealt_sets_agree_with_brute_force(spark, monkeypatch, nulls_equal):
    for owner, name, value in [(K, "PIVOT_VALUES", 30), (K, "FREQUENT", 60), (A, "SEEN_OFTEN", 10), (A, "PART_ROWS", 1500)]:
        monkeypatch.setattr(owner, name, value)
    rows = random_rows(1)
    df = spark.createDataFrame(rows, "a int, b double, c bigint, d string, e int".replace("double", "int"))
    df = df.withColumn("b", F.col("b").cast("double"))
    stage = Stage(spark)
    codes = encode(df, stage, nulls_equal)
    pivots = A.Pivots(codes)
    dealt = pivots.deal(SETS)
    assert sorted(c for sets in dealt.values() for c in sets) == sorted(SETS)
    assert (2,) in dealt[None] and len(dealt) > 2 and pivots.frequent(1) is not None
    few, more = [c for c in SETS if len(c) < 3], [c for c in SETS if len(c) > 2]
    seen, agree, passed = evidence.P.Repeats(), set(), set()
    for batch in (few, more):  # the second one above sets whose repeated rows are known
        found, kept = evidence._test_dealt(codes, batch, stage, seen, pivots)
        agree, passed = agree | found, passed | set(kept)
    assert pivots.repeats and len(pivots.narrowed(more)[1]) < len(more)
    assert set(SETS) - passed == repeating(rows, nulls_equal)
    for a in agree:
        keys = [tuple(r[c] for c in a) for r in rows]
        keys = keys if nulls_equal else [k for k in keys if None not in k]
        assert len(set(keys)) < len(keys)


def test_colliding_hashes_are_settled_by_values():
    values = [np.array([1, 2, 1, 2, 3]), np.array([5, 6, 6, 5, 5])]
    part = A.Part([[v] for v in values], [np.zeros(5, bool)] * 2, True)
    part.hashes = [np.zeros(5, np.uint64)] * 2
    assert part.agree_sets((0, 1)) == [] and part.agree_sets((0,)) == [[0]]


def test_large_table_is_not_multiplied_by_the_sets(spark):
    df = spark.range(3000).select(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2000)).alias(f"c{k}") for k in range(6)])
    codes = encode(df, Stage(spark))
    sets = [(0, *c) for n in (1, 2, 3) for c in combinations(range(1, 6), n)]
    plan = A.dealt(codes, codes.rows, 0, sets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Generate" not in plan


def test_search_over_a_large_table(spark, monkeypatch):
    """The whole search with every rung but the first dealt by pivots, beside the records."""
    rng = np.random.default_rng(5)
    rows = [tuple(int(x) for x in r) for r in zip(*[rng.integers(0, k, 4000) for k in (900, 700, 40, 6, 50)])]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
    found = []
    for above in (10**9, 100):
        monkeypatch.setattr(A, "DEAL_ABOVE", above)
        monkeypatch.setattr(K, "PIVOT_VALUES", 500)
        stage = Stage(spark)
        run = evidence.run(encode(df, stage), stage, first_sample=300)
        found.append((sorted(r.combo for r in run.keys.collect()), sorted(r.combo for r in run.nonkeys.collect())))
    assert found[0] == found[1] and found[0][0]
