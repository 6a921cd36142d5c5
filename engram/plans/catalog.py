"""Every registered query of the fact engine with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engram.plans import consolidation, enrichment, graphs, listings, operations, queues, search, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (listings, texts, search, consolidation, enrichment, graphs, queues, operations):
    QUERIES |= _part.REGISTER.queries
    ORACLE_SQL |= _part.REGISTER.sql
