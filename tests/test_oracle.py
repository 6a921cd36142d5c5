"""Every registered query with oracle SQL against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from engram.plans import catalog
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


#: Approximate results, and queries that they are held against.
BY_RECALL = {"knn_search_probed": "knn_search", "knn_search_graph": "knn_search", "knn_self_join_cells": "knn_self_join"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(name, spark, tiny, con):
    assert compare(entry.queries()[name], catalog.ORACLE_SQL[name], spark, con, tiny) is None


@pytest.mark.parametrize("name", sorted(BY_RECALL))
def test_recall_of_at_least_nine_in_ten(name, spark, tiny):
    keys = ["query_id", "id"] if "search" in name else ["id", "other"]
    found, exact = ({tuple(r) for r in entry.queries()[n](spark, tiny).select(*keys).collect()} for n in (name, BY_RECALL[name]))
    assert len(found & exact) >= 0.9 * len(exact)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == set(BY_RECALL)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
