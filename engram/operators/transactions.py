"""Changes of facts as one commit: the fact, its audit event and its queue entry, or none of them.

Spark has no transaction over several tables. So a batch of changes is judged first and
written once, one row a change; facts, events, queue entries and pending entries are
projections of that one table. A job that dies leaves no commit behind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.clock import as_rfc3339
from engram.functions.jsons import AUDIT_FIELDS
from engram.operators.numbering import numbered
from engram.operators.outbox import MAX_DEPTH
from engram.operators.scope import latest
from engram.sources.shared import drop, materialise
from engram.sources.tables import delete, upsert

#: Event type of an operation, and of an overflowing queue.
EVENT_TYPES = {"write": "memory.create", "update": "memory.update", "delete": "memory.delete"}
OVERFLOW = "cascade.queue_overflow"
MISSING, EXISTS, UNKNOWN = "missing", "exists", "unknown operation"


@dataclass(frozen=True)
class Commit:
    """``rows``: the written commit. The others are projections of it, ``refused`` apart."""

    rows: DataFrame
    memories: DataFrame
    events: DataFrame
    queue: DataFrame
    pending: DataFrame
    refused: DataFrame
    overflowing: bool

    def forget(self) -> None:
        """Removes the commit's files, once its projections were stored elsewhere."""
        drop(self.rows)


def judged(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` with ``fault``: null, or why a change is refused.

    A write needs an id that is not there, an update one that is; earlier changes of the
    batch count. A delete of a missing fact is refused too, it has nothing to record. The
    last write or delete before a change tells whether the fact is there, whether or not
    that change itself was refused; an unknown operation, or none, tells nothing.
    """
    before = Window.partitionBy("id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    decides = F.last(F.when(F.col("operation").isin("write", "delete"), F.col("operation")), ignorenulls=True).over(before)
    known = memories.select("id").distinct().withColumn("_stored", F.lit(True))
    rows = changes.withColumn("_last", decides).join(known, "id", "left")
    there = F.when(F.col("_last").isNotNull(), F.col("_last") == "write").otherwise(F.col("_stored").isNotNull())
    # A change without an operation has no event to write.
    sound = F.coalesce(F.col("operation").isin(*EVENT_TYPES), F.lit(False))
    fault = F.when(~sound, UNKNOWN).when((F.col("operation") == "write") & there, EXISTS).when((F.col("operation") != "write") & ~there, MISSING)
    return rows.withColumn("fault", fault).drop("_last", "_stored")


def commit(memories: DataFrame, changes: DataFrame, now: Column, depth: int = 0, first_seq: int = 1, overflowing: bool = False, most: int = MAX_DEPTH) -> Commit:
    """All sound changes of a batch at once.

    ``changes``: ``turn`` (unique, the order of the batch), ``operation``, the columns of
    ``memories`` and ``embedding``. Numbers of events start at ``first_seq`` and have no gap.
    The queue holds ``depth`` entries already; what does not fit waits as pending, the last
    change of a fact only. The first change that does not fit writes one overflow event
    unless the queue was ``overflowing`` before. Refused changes take no number.
    """
    told = judged(memories, changes)
    good = numbered(told.where(F.col("fault").isNull()).drop("fault"), ["turn"], "_place")
    room = max(0, most - depth)
    # An entry that fits ends an overflow, so only a full queue goes on overflowing.
    already = overflowing and room == 0
    late = 0 if already else 1
    fits = F.col("_place") < room
    seq = F.lit(first_seq) + F.col("_place") + F.when(F.col("_place") > room, F.lit(late)).otherwise(F.lit(0))
    rows = materialise(good.withColumn("queued", fits).withColumn("seq", seq.cast("bigint")).withColumn("committed_at", now), "commit")
    drop(good)

    last = latest(rows.select("id", "operation", "seq", *[c for c in memories.columns if c != "id"]), ["id"], F.col("seq").desc())
    kept = last.where("operation <> 'delete'").select(*memories.columns)
    state = upsert(delete(memories, last.where("operation = 'delete'").select("id")), kept, ["id"])

    kind = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])[F.col("operation")]
    stamp = as_rfc3339(F.col("committed_at"))
    own = {"event_id": F.concat(F.lit("e"), F.lpad(F.col("seq").cast("string"), 12, "0")), "timestamp": stamp, "event_type": kind, "resource_type": F.lit("memory"), "resource_id": F.col("id"), "boundary": F.col("boundary"), "actor_kind": F.lit("system"), "result": F.lit("success"), "details_json": F.lit("{}")}
    events = rows.select("seq", *[own.get(n, F.lit(None)).cast("string").alias(n) for n in AUDIT_FIELDS])
    if not already:
        at = F.lit(first_seq + room + 1).cast("bigint")
        full = {"event_id": F.concat(F.lit("e"), F.lpad(at.cast("string"), 12, "0")), "timestamp": stamp, "event_type": F.lit(OVERFLOW), "actor_kind": F.lit("system"), "result": F.lit("error"), "details_json": F.lit(f'{{"cap":{most},"action":"pending_sync_fallback"}}')}
        events = events.unionByName(rows.where(F.col("_place") == room).select(at.alias("seq"), *[full.get(n, F.lit(None)).cast("string").alias(n) for n in AUDIT_FIELDS]))

    payload = F.when(F.col("operation") != "delete", F.to_json(F.struct("embedding", "boundary")))
    entry = rows.select("id", "operation", payload.alias("payload"), "seq", "committed_at", "queued")
    queue = entry.where("queued").select(
        F.lpad(F.col("seq").cast("string"), 12, "0").alias("id"), F.col("id").alias("memory_id"), "operation", "payload", F.col("seq").alias("sequence_id"),
        F.lit(0).alias("attempts_made"), F.col("committed_at").alias("next_attempt_at"), F.col("committed_at").alias("created_at"), F.lit(None).cast("string").alias("last_error"),
    )
    waits = latest(entry.where("not queued"), ["id"], F.col("seq").desc())
    pending = waits.select(F.col("id").alias("memory_id"), F.col("committed_at").alias("queued_at"), "operation", "payload", F.col("seq").alias("sequence_id"))
    full_now = overflowing if rows.isEmpty() else not rows.where("not queued").isEmpty()
    return Commit(rows, state, events, queue, pending, told.where(F.col("fault").isNotNull()), full_now)
