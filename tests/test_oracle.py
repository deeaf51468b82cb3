"""Every query with SQL equals DuckDB on the small tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, db, name):
    rows, problems = compare(QUERIES[name](spark, SF_DIR), db, ORACLES[name])
    assert not problems
    assert rows > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_keeps_scores_above_threshold(spark):
    rows = entry(spark).collect()
    assert rows and all(r["score"] >= 0.7 for r in rows)
