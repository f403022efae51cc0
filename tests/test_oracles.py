"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

from pagemill.plans import catalogue
from tests.oracle import compare, connection

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, con, name):
    assert compare(QUERIES[name](spark, small), con, SQL[name]) == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(SQL) > 70
