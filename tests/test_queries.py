"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

QUERIES, SQL = queries(), oracle_sql()
#: Their results are empty on the smallest tables, and an empty result shows nothing.
LARGER = {"AGG4_flood_bins", "JON4_unmapped_stations", "STR3_flood_stream", "WIN4_flood_runs"}
LARGER_SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def larger():
    return connect(LARGER_SF)


@pytest.mark.parametrize("name", sorted(set(SQL) - LARGER))
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, QUERIES[name], SQL[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(LARGER))
def test_matches_sql_on_larger_tables(spark, larger, name):
    assert compare(spark, larger, name, QUERIES[name], SQL[name], LARGER_SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) > 1 and rows == sorted(rows, key=lambda r: r.start)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
