"""Every registered query against its SQL in DuckDB, and without SQL against the number of rows it must have."""

import pytest

import __spark_entry__ as entry_points
from check_queries import compare, connection

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    matches, message = compare(spark, con, DATA, name)
    assert matches, message


@pytest.mark.parametrize("name, rows", [("footprint", 2), ("content_hash", 14)])
def test_query_without_sql(spark, name, rows):
    assert entry_points.queries()[name](spark, DATA).count() == rows


def test_sql_belongs_to_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 46
