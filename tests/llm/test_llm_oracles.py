"""The text operators' queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from oracle import compare
from salescope.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ok, msg = compare(QUERIES[name](spark, sf_dir), con.execute(ORACLES[name]).df())
    assert ok, msg


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert [q for q in names if q.startswith(f"op{n}_")], n
    assert "pipeline" in names
