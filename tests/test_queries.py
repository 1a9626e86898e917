"""Every registered query beside its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check_queries import compare, duck

SF_DIR = "/root/testdata/sf0.001"
FOUND, SQL = entry.own_queries(), entry.own_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(FOUND) == set(SQL)


def test_entry(spark):
    assert {r.combo for r in entry.entry(spark).collect()} == {"0", "3", "1,2,4", "1,4,5"}


@pytest.mark.parametrize("name", list(FOUND))
def test_query(spark, con, name):
    assert compare(FOUND[name](spark, SF_DIR), con, SQL[name]) == ""
