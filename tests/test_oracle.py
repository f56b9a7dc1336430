"""Every named query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry_points
from tests.oracle import connect, difference

QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf_dir, con):
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark, sf_dir):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows


def test_entry(spark):
    assert entry_points.entry(spark).count() == 11


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
