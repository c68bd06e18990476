"""Every registered query against its SQL in DuckDB, whole results, types included."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
import oracle_queries

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(entry.library_queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(entry.library_queries()[name](spark, FOLDER), con, SQL[name]) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [(r.delivery_status, r.order_count) for r in rows] == [("Late", 286), ("On Time", 689)]
