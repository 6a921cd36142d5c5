"""Checkpoints of consolidation runs: a header with its status and the entries to undo the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators.consolidate import create_checkpoint, rollback
from engram.sources.tables import CHECKPOINTS_KEPT, keep_latest

ACTIVE, ROLLED_BACK = "active", "rolled_back"
HEADER = "checkpoint_id string, created_at timestamp, status string, entries long"


class UnknownCheckpoint(LookupError):
    pass


class AlreadyRolledBack(ValueError):
    pass


def record(headers: DataFrame, stored: DataFrame | None, entries: DataFrame, checkpoint_id: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """``(headers, entries of all checkpoints)`` with a new one; an empty checkpoint is an error."""
    mine = create_checkpoint(entries, checkpoint_id)
    head = mine.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(checkpoint_id).alias("checkpoint_id"), now.alias("created_at"), F.lit(ACTIVE).alias("status"), "entries")
    return headers.unionByName(head), mine if stored is None else stored.unionByName(mine)


def listing(headers: DataFrame) -> DataFrame:
    """Newest first, then by id descending."""
    return headers.orderBy(F.col("created_at").desc(), F.col("checkpoint_id").desc())


def roll_back(headers: DataFrame, stored: DataFrame, memories: DataFrame, checkpoint_id: str) -> tuple[DataFrame, DataFrame]:
    """``(headers, memories)`` after undoing a checkpoint; each is undone once at most."""
    found = headers.where(F.col("checkpoint_id") == checkpoint_id).select("status").first()
    if found is None:
        raise UnknownCheckpoint(checkpoint_id)
    if found.status == ROLLED_BACK:
        raise AlreadyRolledBack(checkpoint_id)
    spent = headers.withColumn("status", F.when(F.col("checkpoint_id") == checkpoint_id, ROLLED_BACK).otherwise(F.col("status")))
    return spent, rollback(memories, stored.where(F.col("checkpoint_id") == checkpoint_id))


def retained(headers: DataFrame, stored: DataFrame, kept: int = CHECKPOINTS_KEPT) -> tuple[DataFrame, DataFrame]:
    """The newest ``kept`` checkpoints with their entries."""
    newest = keep_latest(headers, [], kept, F.col("created_at").desc(), F.col("checkpoint_id").desc())
    return newest, stored.join(newest.select("checkpoint_id"), "checkpoint_id", "left_semi")
