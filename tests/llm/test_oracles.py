"""The columns of operators that SQL can say, against DuckDB."""

import pytest

from pagemill.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, name, sf):
    d = f"/root/testdata/{sf}"
    assert oracle.compare(queries.queries()[name](spark, d), oracle.connection(d), queries.oracle_sql()[name]) == ""
