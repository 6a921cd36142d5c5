"""Change queue: polling, latest-wins application, retry, dead letters and overflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.clock import MAX_ATTEMPTS, next_attempt
from engram.functions.text import cut_bytes

MAX_DEPTH = 10_000


def due(queue: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Entries whose time has come, in order of sequence."""
    rows = queue.where(F.col("next_attempt_at") <= now).orderBy("sequence_id", "next_attempt_at")
    return rows if limit is None else rows.limit(limit)


def unresolved(dead: DataFrame, limit: int | None = None) -> DataFrame:
    rows = dead.where(F.col("resolution").isNull()).orderBy("id")
    return rows if limit is None else rows.limit(limit)


def oldest_pending(pending: DataFrame, limit: int | None = None) -> DataFrame:
    rows = pending.orderBy("queued_at", "memory_id")
    return rows if limit is None else rows.limit(limit)


def net_changes(queue: DataFrame) -> DataFrame:
    """The last change of each fact by sequence; earlier ones have no effect.

    A maximum over a struct, so each partition sends one row a fact at most.
    """
    last = queue.groupBy("memory_id").agg(F.max(F.struct("sequence_id", "operation", "payload")).alias("l"))
    return last.select("memory_id", "l.sequence_id", "l.operation", "l.payload")


def apply_changes(target: DataFrame, queue: DataFrame) -> DataFrame:
    """``memory_id, payload, sequence_id, deleted`` after a queue: idempotent, older changes never win.

    A deleted fact leaves its sequence number behind (``deleted``, no payload), so that an
    older change that comes late cannot bring it back. ``live`` are the other rows.
    """
    state = target if "deleted" in target.columns else target.withColumn("deleted", F.lit(False))
    last = net_changes(queue).select("memory_id", F.col("sequence_id").alias("_seq"), F.col("payload").alias("_payload"), (F.col("operation") == "delete").alias("_gone"))
    both = state.join(last, "memory_id", "full")
    newer = F.col("_seq").isNotNull() & (F.col("sequence_id").isNull() | (F.col("_seq") > F.col("sequence_id")))
    payload = F.when(newer, F.when(~F.col("_gone"), F.col("_payload"))).otherwise(F.col("payload"))
    return both.select(
        "memory_id", payload.alias("payload"), F.when(newer, F.col("_seq")).otherwise(F.col("sequence_id")).alias("sequence_id"), F.when(newer, F.col("_gone")).otherwise(F.col("deleted")).alias("deleted")
    )


def live(state: DataFrame) -> DataFrame:
    """The facts of a state that were not deleted."""
    return state.where(~F.col("deleted")).drop("deleted")


def forget_deleted(state: DataFrame, below: Column | int) -> DataFrame:
    """Drops the marks of deletes numbered under ``below``, once no change older than that can still come."""
    return state.where(~F.col("deleted") | (F.col("sequence_id") >= below))


def after_failures(queue: DataFrame, failures: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The queue with failed entries put off, and the entries that become dead letters.

    ``failures``: ``id, error, permanent, jitter``. An entry dies of a permanent error or
    when its attempts are used up.
    """
    joined = queue.join(failures, "id", "left").withColumn("failed", F.col("error").isNotNull())
    again = next_attempt(F.col("attempts_made"), now, F.col("jitter"))
    dies = F.col("failed") & (F.col("permanent") | (F.col("attempts_made") + 1 >= MAX_ATTEMPTS) | again.isNull())
    judged = joined.withColumn("dies", F.coalesce(dies, F.lit(False)))
    new = {
        "attempts_made": F.when(F.col("failed"), F.col("attempts_made") + 1).otherwise(F.col("attempts_made")),
        "next_attempt_at": F.when(F.col("failed"), again).otherwise(F.col("next_attempt_at")),
        "last_error": F.when(F.col("failed"), cut_bytes(F.col("error"))).otherwise(F.col("last_error")),
    }
    alive = judged.where(~F.col("dies")).select(*[new.get(c, F.col(c)).alias(c) for c in queue.columns])
    dead = judged.where("dies").select(
        "id", "memory_id", F.col("operation").alias("failed_operation"), cut_bytes(F.col("error")).alias("failure_reason"), (F.col("attempts_made") + 1).alias("attempts_made"),
        F.col("created_at").alias("first_failed_at"), now.alias("last_attempted_at"), "payload", F.lit(None).cast("string").alias("resolution"), F.lit(None).cast("timestamp").alias("resolved_at"), "sequence_id",
    )
    return alive, dead


def resolve(dead: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Sets ``resolution`` of unresolved dead letters by ``outcomes`` (``id, outcome``); resolved ones stay."""
    joined = dead.join(outcomes, "id", "left").withColumn("_new", F.col("resolution").isNull() & F.col("outcome").isNotNull())
    return joined.withColumn("resolved_at", F.when(F.col("_new"), now).otherwise(F.col("resolved_at"))).withColumn("resolution", F.when(F.col("_new"), F.col("outcome")).otherwise(F.col("resolution"))).select(*dead.columns)


def drain(depth: int, pending: DataFrame, most: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Pending entries that fit into the queue again, oldest first, and those that go on waiting.

    An entry without a payload cannot be replayed and waits for an operator.
    """
    fits = pending.where(F.col("payload").isNotNull()).orderBy("queued_at", "memory_id").limit(max(0, most - depth))
    return fits, pending.join(fits.select("memory_id"), "memory_id", "left_anti")


def overflow_events(overflow: DataFrame, already: bool, now: Column) -> DataFrame:
    """One audit row for the start of an overflow; none while it goes on (``already``) or without overflow."""
    row = overflow.limit(0 if already else 1)
    return row.select(now.alias("timestamp"), F.lit("queue_overflow").alias("event_type"), F.col("memory_id").alias("resource_id"))


def retry_step(state: DataFrame, queue: DataFrame, now: Column, failures: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One step of the worker: ``(state, queue, dead letters)`` after the due entries were tried.

    ``failures`` (``id, error, permanent, jitter``) are the due entries that did not go
    through; the others are applied and leave the queue.
    """
    tried = due(queue, now, limit)
    failed = failures.join(tried.select("id"), "id", "left_semi")
    done = tried.join(failed.select("id"), "id", "left_anti")
    left, dead = after_failures(queue.join(done.select("id"), "id", "left_anti"), failed, now)
    return apply_changes(state, done), left, dead


def replay(state: DataFrame, dead: DataFrame, ids: DataFrame, failed: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Dead letters tried again by hand: ``(state, dead letters)`` after it.

    ``ids`` names them, ``failed`` those that failed again. Resolved ones are left alone.
    The letter's row needs ``sequence_id`` for the order of its change.
    """
    chosen = unresolved(dead).join(ids.select("id"), "id", "left_semi")
    good = chosen.join(failed.select("id"), "id", "left_anti")
    changes = good.select("memory_id", F.col("failed_operation").alias("operation"), "payload", "sequence_id")
    bad = failed.select("id", F.lit(True).alias("_bad"))
    outcomes = chosen.select("id").join(bad, "id", "left").select("id", F.when(F.col("_bad"), "retried_failed").otherwise("retried_succeeded").alias("outcome"))
    return apply_changes(state, changes), resolve(dead, outcomes, now)


def admit(depth: int, arrivals: DataFrame, most: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Arrivals that still fit into the queue, and the overflow, latest per fact, for the pending table.

    The cut is by ``sequence_id`` order; at most ``most`` rows pass, so the sort is a top-k.
    """
    room = max(0, most - depth)
    ids = arrivals.select("sequence_id").orderBy("sequence_id").limit(room)
    fits = arrivals.join(ids, "sequence_id", "left_semi")
    over = arrivals.join(ids, "sequence_id", "left_anti")
    w = Window.partitionBy("memory_id").orderBy(F.col("sequence_id").desc())
    return fits, over.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") == 1).drop("_turn")


def counts(**tables: DataFrame) -> DataFrame:
    """``name, rows`` of each table."""
    whole = None
    for name, rows in tables.items():
        part = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        whole = part if whole is None else whole.unionByName(part)
    return whole
