"""Scopes, lifecycle predicates, listings and statistics over facts.

The five lifecycle predicates differ on purpose; each caller names the one it means.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.clock import expired

MAX_BATCH_IDS = 32_000


def in_scope(boundaries: list[str], column: str = "boundary") -> Column:
    """The mandatory scope filter; no boundary means no row."""
    return F.col(column).isin(*boundaries) if boundaries else F.lit(False)


def listed() -> Column:
    """Neither superseded nor archived; expired facts count."""
    return F.col("superseded_by").isNull() & F.col("archived_at").isNull()


def semantic_active(now: Column) -> Column:
    return listed() & ~expired(F.col("valid_until"), now)


def keyword_active(now: Column) -> Column:
    """Archived facts are not looked at here; the index leaves them out."""
    return F.col("superseded_by").isNull() & ~expired(F.col("valid_until"), now)


def graph_current() -> Column:
    """Any end of validity, also one to come, counts as gone."""
    return listed() & F.col("valid_until").isNull()


def consolidation_active() -> Column:
    return listed() & F.col("valid_until").isNull()


@dataclass(frozen=True)
class ListFilter:
    """Optional conditions of a listing; all that are set must hold."""

    boundary: str | None = None
    memory_type: str | None = None
    include_superseded: bool = False
    include_archived: bool = False
    created_since: Column | None = None
    valid_at: Column | None = None

    def condition(self) -> Column:
        holds = F.lit(True)
        if self.boundary is not None:
            holds &= F.col("boundary") == self.boundary
        if self.memory_type is not None:
            holds &= F.col("memory_type") == self.memory_type
        if not self.include_superseded:
            holds &= F.col("superseded_by").isNull()
        if not self.include_archived:
            holds &= F.col("archived_at").isNull()
        if self.created_since is not None:
            holds &= F.col("created_at") >= self.created_since
        if self.valid_at is not None:
            holds &= F.col("valid_until").isNull() | (F.col("valid_until") > self.valid_at)
        return holds


def list_memories(memories: DataFrame, by: ListFilter, limit: int | None = None) -> DataFrame:
    """Newest first; ties by id. The limit is the caller's page size."""
    rows = memories.where(by.condition()).orderBy(F.col("created_at").desc(), "id")
    return rows if limit is None else rows.limit(limit)


def get(rows: DataFrame, key: str, column: str = "id") -> DataFrame:
    return rows.where(F.col(column) == key)


def get_batch(memories: DataFrame, ids: list[str]) -> DataFrame:
    """Facts in the order of ``ids`` (``position``); a repeated id counts once, a missing one not."""
    if len(ids) > MAX_BATCH_IDS:
        raise ValueError(f"at most {MAX_BATCH_IDS} ids")
    first = {i: n for n, i in reversed(list(enumerate(ids)))}
    wanted = memories.sparkSession.createDataFrame(list(first.items()), "id string, position int")
    return memories.join(F.broadcast(wanted), "id").orderBy("position")


def authorised(rows: DataFrame, tokens: DataFrame, token_hash: str) -> DataFrame:
    """Rows in the scopes of an unrevoked token."""
    mine = tokens.where((F.col("token_hash") == token_hash) & F.col("revoked_at").isNull()).select(F.explode("boundaries").alias("boundary")).distinct()
    return rows.join(mine, "boundary", "left_semi")


def boundary_stats(boundaries: DataFrame, memories: DataFrame) -> DataFrame:
    """Listed facts in every registered boundary; empty ones are kept with 0.

    Facts are counted per boundary before the join, so what is joined is small.
    """
    counts = memories.where(listed()).groupBy(F.col("boundary").alias("name")).agg(F.count("id").alias("memory_count"))
    return boundaries.join(counts, "name", "left").select("name", "description", "created_at", F.coalesce("memory_count", F.lit(0)).alias("memory_count")).orderBy("name")


def boundary_backfill(memories: DataFrame) -> DataFrame:
    """First use of each boundary."""
    return memories.groupBy(F.col("boundary").alias("name")).agg(F.min("created_at").alias("created_at"))


def by_boundary(memories: DataFrame) -> DataFrame:
    """Active facts of each boundary as a sorted list of ids."""
    return memories.where(consolidation_active()).groupBy("boundary").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") == 1).drop("_turn")
