"""Corpus queries with oracle SQL against DuckDB on the smallest tables."""

import pytest

from engram.llm import queries
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, tiny):
    assert compare(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, connect(tiny), tiny) is None
