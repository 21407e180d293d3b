"""Every registered query against its check SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.checks import compare, connect

SQL = oracle_sql()
ROWS_ONLY = [n for n in queries() if n not in SQL]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows(spark, sf, con, name):
    assert compare(queries()[name](spark, sf), con, SQL[name]) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(spark, sf, name):
    assert not queries()[name](spark, sf).isEmpty()


def test_every_check_belongs_to_a_query():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["crop", "yr", "mon", "wu", "n"]
