"""Column-set operators against plain Python sets."""

import random
from itertools import combinations

import pytest

from keyloom.functions import colsets as cs
from keyloom.operators import combos as C
from keyloom.plans.hitting import hitting_sets
from tests.brute import all_sets, minimal_hitting_sets, sets_of

WIDTH = 7


@pytest.fixture(scope="module")
def family():
    rng = random.Random(3)
    return sorted({tuple(sorted(rng.sample(range(WIDTH), rng.randint(1, 5)))) for _ in range(25)})


@pytest.fixture(scope="module")
def other():
    rng = random.Random(4)
    return sorted({tuple(sorted(rng.sample(range(WIDTH), rng.randint(1, 4)))) for _ in range(25)})


def test_frame_columns(spark):
    row = C.combo_frame(spark, [(0, 3)]).collect()[0]
    assert (row.combo, row.cols, row.mask, row["size"]) == ("0,3", [0, 3], 9, 2)
    wide = C.combo_frame(spark, [(1, 70)]).collect()[0]
    assert wide.mask is None and wide["size"] == 2


def test_combos_of_size(spark):
    whole = C.combo_frame(spark, [tuple(range(WIDTH))])
    for n in (1, 2, 3, WIDTH):
        assert sets_of(C.combos_of_size(whole, n)) == set(combinations(range(WIDTH), n))
    assert sets_of(C.combos_of_size(whole, WIDTH + 1)) == set()


def test_combos_containing(spark):
    whole = C.combo_frame(spark, [(0, 1, 2, 4, 6)])
    want = {c for c in combinations((0, 1, 2, 4, 6), 3) if {1, 6} <= set(c)}
    assert sets_of(C.combos_containing(whole, [6, 1], 3)) == want
    assert sets_of(C.combos_containing(whole, [3], 2)) == set()
    assert sets_of(C.combos_containing(whole, [1, 6], 1)) == set()


def test_direct_neighbours(spark, family):
    df = C.combo_frame(spark, family)
    up = {tuple(sorted({*f, x})) for f in family for x in range(WIDTH) if x not in f}
    assert sets_of(C.direct_supersets(df, cs.universe(WIDTH))) == up
    down = {tuple(x for x in f if x != y) for f in family for y in f if len(f) > 1}
    assert sets_of(C.direct_subsets(df)) == down
    kept = {
        tuple(x for x in f if x != y) for f in family if {2} < set(f) for y in f if y != 2
    }
    assert sets_of(C.direct_subsets(df, keep=[2])) == kept


def test_closures(spark, family):
    df = C.combo_frame(spark, family)
    subsets = {c for c in all_sets(WIDTH) if any(set(c) <= set(f) for f in family)}
    assert sets_of(C.all_subsets(df, WIDTH)) == subsets
    assert sets_of(C.all_subsets(df, WIDTH, with_empty=True)) == subsets | {()}
    supersets = {c for c in all_sets(WIDTH) if any(set(c) >= set(f) for f in family)}
    assert sets_of(C.all_supersets(df, WIDTH)) == supersets


def test_members_and_complement(spark, family):
    df = C.combo_frame(spark, family)
    got = {(r.combo, r.col_idx) for r in C.members(df, WIDTH).where("is_member").collect()}
    assert got == {(",".join(map(str, f)), c) for f in family for c in f}
    want = {tuple(x for x in range(WIDTH) if x not in f) for f in family}
    assert sets_of(C.complement(df, cs.universe(WIDTH))) == want


def test_containment(spark, family, other):
    a, b = C.combo_frame(spark, family), C.combo_frame(spark, other)
    inside = {f for f in family if any(set(f) <= set(o) for o in other)}
    assert sets_of(C.below(a, b, "left_semi")) == inside
    assert sets_of(C.below(a, b, "left_anti")) == set(family) - inside
    over = {f for f in family if any(set(f) >= set(o) for o in other)}
    assert sets_of(C.above(a, b, "left_semi")) == over
    proper = {f for f in family if any(set(f) > set(o) for o in other)}
    assert sets_of(C.above(a, b, "left_semi", proper=True)) == proper
    assert sets_of(C.undecided(a, b, b)) == set(family) - inside - over
    assert sets_of(C.known(a, b)) == set(family) & set(other)


def test_borders(spark, family):
    df = C.combo_frame(spark, family * 2)
    assert sets_of(C.minimal(df)) == {f for f in family if not any(set(o) < set(f) for o in family)}
    assert sets_of(C.maximal(df)) == {f for f in family if not any(set(o) > set(f) for o in family)}


def test_algebra(spark, family, other):
    a, b = C.combo_frame(spark, family), C.combo_frame(spark, other)
    assert sets_of(C.union(a, b)) == set(family) | set(other)
    assert C.union(a, a).count() == len(family)
    assert sets_of(C.difference(a, b)) == set(family) - set(other)
    pairs = C.overlapping(a, b)
    got = {(tuple(r.a_cols), tuple(r.b_cols)) for r in pairs.collect()}
    assert got == {(f, o) for f in family for o in other if set(f) & set(o)}
    for r in C.combine(pairs, "a_cols", "b_cols").collect():
        x, y = set(r.a_cols), set(r.b_cols)
        assert (r.union_cols, r.common_cols, r.only_cols) == (sorted(x | y), sorted(x & y), sorted(x - y))


@pytest.mark.parametrize("at_least", [1, 2, 3])
def test_overlap_of_at_least(spark, family, other, at_least):
    twice = C.combo_frame(spark, [*family, *family])
    rows = C.overlapping(twice, C.combo_frame(spark, other), at_least).collect()
    got = [(tuple(r.a_cols), tuple(r.b_cols)) for r in rows]
    assert len(got) == len(set(got))
    assert set(got) == {(f, o) for f in family for o in other if len(set(f) & set(o)) >= at_least}
    assert C.overlapping(C.combo_frame(spark, []), twice, at_least).count() == 0


def test_overlap_joins_only_rare_members(spark):
    """A member that all sets have joins nothing once two must be shared."""
    from pyspark.sql import functions as F

    sets = C.combo_frame(spark, [(0, k, k + 1) for k in range(1, 200, 2)])
    pairs = C.overlapping(sets, sets, 2)
    assert pairs.count() == 100
    with pytest.raises(ValueError):
        C.overlapping(sets, sets, 0)
    assert C.overlapping(sets, sets).where(F.col("a_cols") != F.col("b_cols")).count() == 100 * 99


def test_canonical_order(spark, family):
    rows = [tuple(r.cols) for r in C.canonical_order(C.combo_frame(spark, family)).collect()]
    assert rows == sorted(family, key=lambda f: (len(f), f))


@pytest.mark.parametrize("seed", range(4))
def test_hitting_sets(spark, seed):
    rng = random.Random(seed)
    families = [tuple(sorted(rng.sample(range(WIDTH), rng.randint(1, 5)))) for _ in range(6)]
    df = C.combo_frame(spark, families)
    found = hitting_sets(df, WIDTH)
    assert found.count() == len(sets_of(found))
    assert sets_of(found) == minimal_hitting_sets(families, WIDTH)
    small = {k for k in minimal_hitting_sets(families, WIDTH) if len(k) <= 2}
    assert sets_of(hitting_sets(df, WIDTH, max_size=2)) == small


def test_hitting_sets_edges(spark):
    whole = C.combo_frame(spark, [(0, 1, 2)])
    assert sets_of(hitting_sets(whole, 3)) == set()
    none = C.combo_frame(spark, [])
    assert sets_of(hitting_sets(none, 3)) == {(0,), (1,), (2,)}


def test_hitting_sets_of_many_nonkeys(spark):
    """20 columns, 1,000 random non-keys, beside brute force over all sets as bits."""
    import numpy as np

    width, rng = 20, random.Random(7)
    nonkeys = [tuple(sorted(rng.sample(range(width), rng.randint(2, 5)))) for _ in range(1000)]
    inside = np.zeros(2**width, bool)
    inside[[sum(1 << c for c in k) for k in nonkeys]] = True
    masks = np.arange(2**width)
    for c in range(width):  # what lies inside a larger set lies inside
        without = masks[(masks >> c) & 1 == 0]
        inside[without] |= inside[without | 1 << c]
    minimal = ~inside
    for c in range(width):
        having = masks[(masks >> c) & 1 == 1]
        minimal[having] &= inside[having ^ 1 << c]
    found = hitting_sets(C.combo_frame(spark, nonkeys), width)
    assert {sum(1 << c for c in s) for s in sets_of(found)} == set(np.flatnonzero(minimal).tolist())


def test_a_level_of_hitting_sets_is_one_join(spark, tmp_path):
    from keyloom.plans import hitting as H

    nonkeys = C.combo_frame(spark, [(0, 1, 2), (2, 3), (1, 4)]).select("combo", "cols")
    H.first_lists(H.single_sets(spark, 5), nonkeys, 5).write.parquet(f"{tmp_path}/lists")
    lists = spark.read.parquet(f"{tmp_path}/lists")
    H.needed_sets(lists).write.parquet(f"{tmp_path}/sets")
    following = H.next_lists(lists, spark.read.parquet(f"{tmp_path}/sets").where("hole IS NOT NULL"))
    plan = following._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert H.needed_sets(lists)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 0


def test_grow_from_larger_sets(spark):
    """Start sets of any size: all minimal sets above them, none whose columns are not all needed."""
    from keyloom.plans import hitting as H
    from keyloom.staging import Stage

    rng = random.Random(3)
    nonkeys = list({tuple(sorted(rng.sample(range(WIDTH), rng.randint(1, 4)))) for _ in range(7)})
    every = minimal_hitting_sets(nonkeys, WIDTH)
    top = C.maximal(C.combo_frame(spark, nonkeys)).select("combo", "cols")
    for start in ([(0,), (1, 2)], [(0, 3), (1, 2, 4)], [(2,), (2, 3), (0, 1, 5)]):
        got = sets_of(H.grow(C.combo_frame(spark, start).select("combo", "cols"), top, WIDTH, Stage(spark)))
        assert got == {k for k in every if any(set(s) <= set(k) for s in start)}


def test_hitting_sets_wide(spark):
    """More than 63 columns: positions, not bits."""
    width = 80
    nonkeys = [tuple(i for i in range(width) if i not in (0, 70)), tuple(i for i in range(width) if i != 79)]
    got = sets_of(hitting_sets(C.combo_frame(spark, nonkeys), width))
    assert got == {(0, 79), (70, 79)}


def test_containment_has_no_hot_pair(spark):
    """All sets of 16 columns: every subset looks up its own two rarest members."""
    from pyspark.sql import functions as F

    sets = spark.range(1, 2**16).select(
        F.filter(F.sequence(F.lit(0), F.lit(15)), lambda i: F.call_function("shiftright", F.col("id"), i).bitwiseAND(F.lit(1)) == 1).alias("cols")
    )
    pairs = C.with_own_pair(sets, sets).groupBy("own_pair").count().collect()
    assert len(pairs) == 16 + 120
    assert max(r["count"] for r in pairs) < 0.02 * 2**16


def test_rare_members_are_looked_up(spark):
    tops = C.combo_frame(spark, [(0, 1, k) for k in range(2, 12)])
    asked = C.combo_frame(spark, [(0, 1, 2), (0, 5), (0, 1), (3,), (0, 2, 3)])
    found = {r.combo: r.own_pair for r in C.with_own_pair(asked, tops).collect()}
    assert found["0,1,2"] in ("0,2", "1,2") and found["0,5"] == "0,5" and found["3"] == "3,3" and found["0,2,3"] == "2,3"
    assert {r.combo for r in C.below(asked, tops, "left_semi").collect()} == {"0,1,2", "0,5", "0,1", "3"}
    assert {r.combo for r in C.above(tops, asked, "left_anti").collect()} == set()
