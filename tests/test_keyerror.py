"""Key errors of large tables: one shuffle for all combos of a pivot, the same counts as by grouping sets."""

import datetime as dt
import random

import pytest

from keyloom.operators import keyerror as K
from tests.brute import all_sets

SCHEMA = "a bigint, b string, c double, d date, e map<string, int>"


@pytest.fixture(scope="module")
def table(spark):
    """Values that many rows share, keys but for a few rows, nulls, zeros of either sign and NaN."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        row = [
            None if i % 50 == 0 else 7 if i % 3 == 0 else i - i % 2,
            f"t{rng.randrange(40)}",
            rng.choice([0.0, -0.0, float("nan"), 1.5, None, float(rng.randrange(900))]),
            rng.choice([None, dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(30))]),
            {"x": rng.randrange(3)},
        ]
        rows += [row] * (2 if i % 100 == 1 else 1)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("nulls_equal", [True, False])
@pytest.mark.parametrize("frequent", [400, 10**9])
def test_large_tables_have_the_same_errors(table, monkeypatch, nulls_equal, frequent):
    sets = all_sets(5)
    plain = {(r.combo, r.n_clusters, r.key_error) for r in K.key_errors(table, sets, nulls_equal).collect()}
    settings = {"PIVOT_ABOVE": 0, "FOLDED": 300, "PIVOT_VALUES": 30, "PART_RECORDS": 20_000, "FREQUENT": frequent}
    for name, value in settings.items():
        monkeypatch.setattr(K, name, value)
    large = K.key_errors(table, sets, nulls_equal).collect()
    assert len(large) == len(sets)
    assert {(r.combo, r.n_clusters, r.key_error) for r in large} == plain


def test_rows_are_not_multiplied_by_the_combos(table, monkeypatch):
    """All sets above one pivot are counted from one shuffle of the rows, and none by grouping sets."""
    for name, value in [("PIVOT_ABOVE", 0), ("FOLDED", 1), ("PIVOT_VALUES", 30), ("FREQUENT", 10**9)]:
        monkeypatch.setattr(K, name, value)
    sets = [(0,), (0, 1), (0, 2), (0, 1, 2), (0, 1, 3), (0, 3)]
    plan = K.key_errors(table, sets)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert plan.count("hashpartitioning(a0") == 1


def test_empty_table(spark, table):
    assert K.key_errors(table.limit(0), all_sets(3)).collect() == []
