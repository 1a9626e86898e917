"""Fixtures with known answers, and random tables against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import keyloom
from keyloom.functions import values as V
from keyloom.operators import combos as C
from keyloom.operators import fingerprint as P
from keyloom.operators import keyerror as K
from keyloom.operators.cells import cells
from keyloom.plans import encode as E
from keyloom.plans import evidence, levelwise
from keyloom.plans.encode import encode
from keyloom.plans.hitting import hitting_sets
from keyloom.staging import Stage
from tests import brute
from tests.brute import sets_of


def frame(spark, rows, names="abcdefgh", dtype="int"):
    width = len(rows[0])
    return spark.createDataFrame(rows, ", ".join(f"{names[i]} {dtype}" for i in range(width)))


def small(spark, df, nulls_equal=True, **options):
    stage = Stage(spark)
    return evidence.run(encode(df, stage, nulls_equal), stage, **options)


def letters(text):
    return {tuple(sorted("ABCDEF".index(c) for c in word)) for word in text.split()}


SIX = [
    (0, 0, 0, 0, 0, 0),
    (1, 0, 0, 0, 1, 1),
    (0, 2, 0, 2, 0, 2),
    (0, 0, 3, 3, 3, 0),
]
THREE = [(1, "a", "p"), (2, "a", "q"), (3, "b", "p")]


@pytest.mark.parametrize("method", ["evidence", "levels"])
def test_six_columns(spark, method):
    df = frame(spark, SIX)
    assert sets_of(keyloom.minimal_keys(df, method=method)) == letters("AD BE CF DE DF EF ABC")
    assert sets_of(keyloom.maximal_nonkeys(df, method=method)) == letters("ABF ACE BCD")


@pytest.mark.parametrize("method", ["evidence", "levels"])
def test_unique_column_beside_composite(spark, method):
    df = spark.createDataFrame(THREE, "id int, x string, y string")
    found = keyloom.minimal_keys(df, method=method)
    assert {(r.combo, tuple(r.names), r.key_error) for r in found.collect()} == {
        ("0", ("id",), 0),
        ("1,2", ("x", "y"), 0),
    }
    assert sets_of(keyloom.maximal_nonkeys(df, method=method)) == {(1,), (2,)}
    assert keyloom.key_count(df).collect()[0].n_keys == 2


def test_tolerance_makes_every_column_a_key(spark):
    df = spark.createDataFrame(THREE, "id int, x string, y string")
    found = keyloom.minimal_keys(df, tolerance=1)
    assert {(r.combo, r.key_error) for r in found.collect()} == {("0", 0), ("1", 1), ("2", 1)}
    assert sets_of(keyloom.maximal_nonkeys(df, tolerance=1)) == set()
    assert sets_of(keyloom.minimal_keys(df, tolerance=1, method="levels")) == {(0,), (1,), (2,)}
    with pytest.raises(ValueError):
        keyloom.minimal_keys(df, method="guess")


@pytest.mark.parametrize("seed, nulls_equal", [(21, True), (22, False), (23, True)])
def test_tolerant_evidence(spark, seed, nulls_equal):
    """Samples refute by their counts; failed sets are grown; the errors are those of the table."""
    rows = random_rows(seed, 300, 6, 4)
    for tolerance in (2, 25, 290):
        found = small(spark, frame(spark, rows), nulls_equal, first_sample=40, tolerance=tolerance)
        errors = {c: brute.key_error(rows, c) for c in brute.all_sets(6)}
        keys = {c for c, e in errors.items() if e <= tolerance}
        least = {c for c in keys if not any(set(k) < set(c) for k in keys)}
        most = {c for c in errors if c not in keys and all(not set(c) < set(d) for d in errors if d not in keys)}
        assert {(tuple(r.cols), r.key_error) for r in found.keys.collect()} == {(c, errors[c]) for c in least}
        assert sets_of(found.nonkeys) == most


@pytest.mark.parametrize("method", ["evidence", "levels"])
def test_equal_rows_have_no_key(spark, method):
    df = frame(spark, [(1, 2, 3), (1, 2, 3), (4, 5, 6)])
    assert sets_of(keyloom.minimal_keys(df, method=method)) == set()
    assert sets_of(keyloom.maximal_nonkeys(df, method=method)) == {(0, 1, 2)}


@pytest.mark.parametrize("method", ["evidence", "levels"])
def test_one_row_and_no_row(spark, method):
    one = frame(spark, [(1, 2)])
    assert sets_of(keyloom.minimal_keys(one, method=method)) == {(0,), (1,)}
    assert sets_of(keyloom.maximal_nonkeys(one, method=method)) == set()
    none = one.where("a > 5")
    assert keyloom.minimal_keys(none, method=method).count() == 0
    assert keyloom.maximal_nonkeys(none, method=method).count() == 0


def test_nulls(spark):
    rows = [(1, None), (1, None), (2, "x"), (2, "x"), (3, "y")]
    df = spark.createDataFrame(rows, "a int, b string")
    errors = {r.combo: r.key_error for r in K.key_errors(df, [(0,), (1,), (0, 1)]).collect()}
    assert errors == {"0": 2, "1": 2, "0,1": 2}
    errors = K.key_errors(df, [["a"], ["b"], ["a", "b"]], nulls_equal=False)
    assert {r.combo: r.key_error for r in errors.collect()} == {"0": 2, "1": 1, "0,1": 1}
    allnull = spark.createDataFrame([(None,), (None,)], "a int")
    assert K.key_errors(allnull, [(0,)], nulls_equal=False).collect()[0].key_error == 0


def random_rows(seed, n_rows, width, values, nulls=0.0):
    rng = random.Random(seed)
    return [
        tuple(None if rng.random() < nulls else rng.randrange(values + c) for c in range(width))
        for _ in range(n_rows)
    ]


@pytest.mark.parametrize("seed,n_rows,width,values", [(1, 30, 5, 3), (2, 200, 6, 5), (3, 60, 7, 3)])
def test_random_tables(spark, seed, n_rows, width, values):
    rows = random_rows(seed, n_rows, width, values)
    df = frame(spark, rows)
    keys, rest = brute.minimal_keys(rows, width), brute.maximal_nonkeys(rows, width)
    found = small(spark, df, first_sample=16)  # several samples before the table
    assert sets_of(found.keys) == keys
    assert sets_of(found.nonkeys) == rest
    assert sets_of(keyloom.minimal_keys(df, method="levels")) == keys
    # duality: each border is the hitting sets of the other
    if rest:
        assert sets_of(hitting_sets(C.combo_frame(spark, rest), width)) == keys


@pytest.mark.parametrize("seed", [5, 6])
def test_random_tables_with_distinct_nulls(spark, seed):
    rows = random_rows(seed, 60, 5, 4, nulls=0.15)
    df = frame(spark, rows)
    for nulls_equal in (True, False):
        keys = brute.minimal_keys(rows, 5, nulls_equal=nulls_equal)
        rest = brute.maximal_nonkeys(rows, 5, nulls_equal=nulls_equal)
        found = small(spark, df, nulls_equal, first_sample=16)
        assert sets_of(found.keys) == keys
        assert sets_of(found.nonkeys) == rest
        assert sets_of(keyloom.minimal_keys(df, nulls_equal=nulls_equal, method="levels")) == keys


@pytest.mark.parametrize("tolerance", [1, 4])
def test_tolerant_keys(spark, tolerance):
    rows = random_rows(7, 80, 5, 4)
    df = frame(spark, rows)
    found = keyloom.minimal_keys(df, tolerance=tolerance).collect()
    want = brute.minimal_keys(rows, 5, tolerance)
    assert {(tuple(r.cols), r.key_error) for r in found} == {(k, brute.key_error(rows, k)) for k in want}
    assert sets_of(keyloom.maximal_nonkeys(df, tolerance=tolerance)) == brute.maximal_nonkeys(rows, 5, tolerance)


def test_layout_does_not_matter(spark):
    rows = random_rows(8, 120, 5, 4)
    want = brute.minimal_keys(rows, 5)
    df = frame(spark, rows)
    mixed = df.orderBy(F.rand(1)).repartition(5)
    assert sets_of(keyloom.minimal_keys(mixed, method="evidence")) == want
    assert sets_of(keyloom.minimal_keys(mixed, method="levels")) == want
    turned = df.select("e", "d", "c", "b", "a")
    assert {tuple(sorted(4 - c for c in k)) for k in sets_of(keyloom.minimal_keys(turned))} == want
    assert sets_of(keyloom.minimal_keys(df, columns=["a", "c"])) == brute.minimal_keys(
        [(r[0], r[2]) for r in rows], 2
    )


def test_small_batches(spark, monkeypatch):
    rows = random_rows(9, 120, 6, 4)
    monkeypatch.setattr(evidence, "BATCH", 3)
    monkeypatch.setattr(P, "SLICE", 2)
    found = small(spark, frame(spark, rows), first_sample=20)
    assert sets_of(found.keys) == brute.minimal_keys(rows, 6)
    errors = K.key_errors(frame(spark, rows), brute.all_sets(6), batch=4)
    assert {(tuple(r.cols), r.key_error) for r in errors.collect()} == {
        (c, brute.key_error(rows, c)) for c in brute.all_sets(6)
    }


def test_hash_collisions_do_not_change_the_result(spark, monkeypatch):
    rows = random_rows(10, 90, 5, 5)
    want = brute.minimal_keys(rows, 5), brute.maximal_nonkeys(rows, 5)
    monkeypatch.setattr(P, "PURGE_ABOVE", 0)
    first, second = P._first_hash, P._second_hash
    monkeypatch.setattr(P, "_first_hash", lambda c: f"pmod({first(c)}, 5)")
    monkeypatch.setattr(P, "_second_hash", lambda c: f"pmod({second(c)}, 2)")
    found = small(spark, frame(spark, rows), first_sample=16)
    assert (sets_of(found.keys), sets_of(found.nonkeys)) == want


def test_colliding_codes_are_replaced(spark, monkeypatch):
    hashed = V.seeded_hash
    monkeypatch.setattr(
        V, "seeded_hash", lambda c, t, s: F.pmod(hashed(c, t, s), F.lit(2)) if s in (42, 1013) else hashed(c, t, s)
    )
    df = spark.createDataFrame([(w,) for w in "abcdefgh"], "w string")
    assert sets_of(keyloom.minimal_keys(df)) == {(0,)}


def test_purge_by_repeats_of_subsets(spark, monkeypatch):
    """The filter leaves the repeats of a superset exactly as they are without it."""
    monkeypatch.setattr(P, "PURGE_ABOVE", 0)
    rows = random_rows(11, 400, 5, 9)
    df = frame(spark, rows)
    assert sets_of(small(spark, df, first_sample=16).keys) == brute.minimal_keys(rows, 5)
    stage = Stage(spark)
    codes = encode(df, stage)
    singles, seen = [(c,) for c in range(5)], P.Repeats()
    P.screen(codes, singles, stage, seen)
    pairs = [(0, 1), (2, 4), (1, 2, 3)]
    assert set(seen.parents(pairs)) == set(pairs)
    plain = P.screen(codes, pairs, stage, P.Repeats()).repeats
    assert P.screen(codes, pairs, stage, seen).repeats == plain


def test_max_size_and_exclude(spark):
    df = frame(spark, SIX)
    for method in ("evidence", "levels"):
        two = keyloom.minimal_keys(df, max_size=2, method=method)
        assert sets_of(two) == letters("AD BE CF DE DF EF")
        without = keyloom.minimal_keys(df, exclude=F.array_contains("cols", 3), method=method)
        assert sets_of(without) == letters("BE CF EF ABC")


def test_verdicts(spark):
    rows = random_rows(12, 40, 5, 3)
    df = frame(spark, rows)
    keys = brute.minimal_keys(rows, 5)
    want = {
        c: brute.key_error(rows, c)
        for c in brute.all_sets(5)
        if not any(set(k) < set(c) for k in keys)
    }
    got = keyloom.verdicts(df).collect()
    assert {tuple(r.cols): r.key_error for r in got} == want
    assert all(r.is_key == (r.key_error == 0) and r.how == "counted" for r in got)
    bounded = keyloom.verdicts(df, use_bounds=True).collect()
    assert {tuple(r.cols): r.is_key for r in bounded} == {c: e == 0 for c, e in want.items()}
    assert any(r.how == "bound" for r in bounded)


def test_value_types(spark):
    """Zeros, NaN, nested values and maps compare as grouping compares them."""
    df = spark.sql(
        """SELECT * FROM VALUES
        (0.0D, double('NaN'), array(1, null), map('k', 1, 'l', 2), named_struct('x', 1, 'y', null), X'01'),
        (-0.0D, double('NaN'), array(null, 1), map('l', 2, 'k', 1), named_struct('x', null, 'y', 1), X'0100'),
        (1.0D, 2.0D, array(), map('k', 2), named_struct('x', 2, 'y', 2), X'02')
        AS t(zero, nan, list, dict, pair, bytes)"""
    )
    for method in ("evidence", "levels"):
        assert sets_of(keyloom.minimal_keys(df, method=method)) == {(2,), (4,), (5,)}
        assert sets_of(keyloom.maximal_nonkeys(df, method=method)) == {(0, 1, 3)}


def test_wide_table(spark):
    """More than 63 columns."""
    width = 70
    rows = [tuple(0 for _ in range(width)), tuple(1 if c == 69 else 0 for c in range(width)),
            tuple(1 if c in (3, 68) else 0 for c in range(width))]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(width)))
    found = keyloom.minimal_keys(df)
    assert sets_of(found) == {(3, 69), (68, 69)}
    assert all(r.mask is None for r in found.collect())
    errors = K.key_errors(df, [tuple(range(width)), (3, 69), (0, 1)]).collect()
    assert {r["size"]: r.key_error for r in errors} == {70: 0, 2: 0} or {
        (r["size"], r.key_error) for r in errors
    } == {(70, 0), (2, 0), (2, 2)}


def test_sample_rules_out(spark):
    rows = [(i % 40, i % 20, i % 41, i // 10) for i in range(300)]
    stage = Stage(spark)
    codes = encode(frame(spark, rows), stage)
    for tolerance in (0, 3):
        found = levelwise.run(codes, stage, tolerance, sample=36).collect()
        keys = {(tuple(r.cols), r.key_error) for r in found if r.is_key}
        want = brute.minimal_keys(rows, 4, tolerance)
        assert keys == {(k, brute.key_error(rows, k)) for k in want}
        assert {r.how for r in found} >= {"counted", "sample"}
        assert all(brute.key_error(rows, r.cols) > tolerance for r in found if not r.is_key)


def test_level_generation(spark):
    nonkeys = C.combo_frame(spark, [(0, 1), (0, 2), (1, 2), (1, 3)])
    assert sets_of(levelwise.next_level(nonkeys, 4)) == {(0, 1, 2)}


COLLATED = """
    select id, v collate UTF8_LCASE as v, w collate UTF8_LCASE as w, array(v collate UTF8_LCASE) as list,
           named_struct('x', v collate UTF8_LCASE, 'k1', 0.0D) as pair, map(w collate UTF8_LCASE, id % 2) as m
    from values (1, 'a', 'p'), (2, 'A', 'P'), (3, 'b', 'q'), (4, 'B', 'r'), (5, 'c', 'Q') as t(id, v, w)
"""


@pytest.mark.parametrize("method", ["evidence", "levels"])
def test_collated_strings_follow_their_collation(spark, method):
    """'a' and 'A' are one value, also inside nested values; grouping is the measure."""
    df = spark.sql(COLLATED).drop("id")
    found = sets_of(keyloom.minimal_keys(df, method=method))
    keys = []
    for size in range(1, 6):
        for combo in itertools.combinations(range(5), size):
            if any(set(k) <= set(combo) for k in keys):
                continue
            if df.groupBy(*[df.columns[c] for c in combo]).count().where("count > 1").isEmpty():
                keys.append(combo)
    assert found == set(keys)
    assert (0,) not in found and (1,) not in found and (0, 1) not in found


def test_collated_cells_and_nulls(spark):
    df = spark.sql("select id, v collate UTF8_LCASE as v from values (1, 'a'), (2, 'A'), (3, null), (4, 'b') as t(id, v)")
    got = {r.row_id: r.value for r in cells(df, "id").collect()}
    assert got == {1: "A", 2: "A", 3: None, 4: "b"}
    assert sets_of(keyloom.minimal_keys(df.select("v"))) == set()
    plain = df.select(df.id, df.v.cast("string").alias("v"))
    assert sets_of(keyloom.minimal_keys(plain.select("v"))) == {(0,)}


def test_nonkeys_within_limits(spark):
    rng = random.Random(11)
    rows = [tuple(rng.randint(0, 2) for _ in range(5)) for _ in range(24)]
    df = frame(spark, rows)
    failing = [c for c in brute.all_sets(5) if brute.key_error(rows, c)]

    def largest(allowed):
        rest = [c for c in failing if allowed(c)]
        return {k for k in rest if not any(set(o) > set(k) for o in rest)}

    for n in (1, 2, 4):
        assert sets_of(keyloom.maximal_nonkeys(df, max_size=n)) == largest(lambda c: len(c) <= n)
    assert keyloom.maximal_nonkeys(df, max_size=0).count() == 0
    out = F.array_contains("cols", 0) & F.array_contains("cols", 2)
    assert sets_of(keyloom.maximal_nonkeys(df, exclude=out)) == largest(lambda c: not {0, 2} <= set(c))
    got = sets_of(keyloom.maximal_nonkeys(df, max_size=3, exclude=out, method="levels"))
    assert got == largest(lambda c: len(c) <= 3 and not {0, 2} <= set(c))


def exchanged(spark, df):
    """The types of all columns that the plan of ``df`` sends through a shuffle."""
    def below(node):
        yield node
        for i in range(node.children().size()):
            yield from below(node.children().apply(i))

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = [n for n in below(df._jdf.queryExecution().executedPlan()) if n.nodeName() == "Exchange"]
        return [n.output().apply(i).dataType().simpleString() for n in found for i in range(n.output().size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_no_text_is_shuffled_to_prove_codes(spark):
    texts = ["", "x" * 31, "x" * 32, "y" * 100_000, "ä" * 16, None]
    df = spark.createDataFrame([(t, (t or "").encode()) for t in texts], "t string, b binary")
    df = spark.createDataFrame(df.toArrow())
    coded = {i: E._codes(F.col(c), f.dataType, i, 0) for i, (c, f) in enumerate(zip(df.columns, df.schema.fields))}
    types = exchanged(spark, E._code_proofs(df, coded))
    assert types and "string" not in types
    sizes = df.select(F.octet_length(E._proof(F.col("t"))).alias("n")).collect()
    assert [r.n for r in sizes] == [0, 31, 32, 32, 32, None]
    assert not E._collides(df, coded)


@pytest.mark.parametrize("pair", [("a", "b"), ("x" * 50, "x" * 49 + "y"), ("x" * 31, "x" * 32), ("", None)])
def test_codes_of_two_values_are_found_out(spark, pair):
    one = [F.lit(1).cast("bigint").alias("a0"), F.lit(2).cast("bigint").alias("b0")]
    for dtype, rows in (("string", pair), ("binary", [None if p is None else p.encode() for p in pair])):
        df = spark.createDataFrame([(v,) for v in [*rows, *rows]], f"v {dtype}")
        assert E._collides(df, {0: one})
        assert not E._collides(df.where(F.col("v") == F.lit(rows[0])), {0: one})
