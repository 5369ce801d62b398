"""Every query with SQL agrees with DuckDB; every other query returns rows."""

import pytest
from compare import compare, database

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, sf, con, name):
    assert compare(queries()[name](spark, sf), con, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_returns_rows(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 10


def test_sql_only_for_known_queries():
    assert set(oracle_sql()) <= set(queries())
