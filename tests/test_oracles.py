"""Every SQL-expressible registered query equals its DuckDB oracle on the
smallest test tables (the build driver repeats this at sf0.01)."""

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from salescope import plans

SQL = plans.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    cols = df.columns
    assert cols[:2] == ["date", "revenue"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, sf_dir, con, name):
    ok, msg = compare(QUERIES[name](spark, sf_dir), con.execute(SQL[name]).df())
    assert ok, f"{name}: {msg}"
