"""The retry worker as a stateful stream: one state a fact, timers for the backoff.

A change is tried when it comes or when its time has come. One that fails is put off by the
backoff of its attempts; after a permanent error, or once the attempts are used up, it is a
dead letter. Every change that is settled is one row of the output, which is only ever added
to: the state of the facts is the latest applied change of each, and no table is written anew.
A deleted fact leaves its number for ``keep_deleted`` seconds, so that an older change that
comes late cannot bring it back.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from engram.functions.clock import BACKOFF_SECONDS, JITTER_SHARE

#: ``attempt(changes)`` writes changes to the second store: a row each of ``error`` (null if it
#: went through), ``permanent`` and ``jitter`` (-1 to 1). Given ``id, memory_id, sequence_id, operation, payload, attempts_made``.
Attempt = Callable[[pd.DataFrame], pd.DataFrame]
APPLIED, OLDER, DEAD, FORGOTTEN = "applied", "older", "dead", "forgotten"
KEEP_DELETED = 7 * 86_400
WAITING = "id string, sequence_id bigint, operation string, payload string, attempts_made int, due_ms bigint, created_ms bigint"
SETTLED = "kind string, memory_id string, id string, sequence_id bigint, operation string, payload string, attempts_made int, error string, created_ms bigint, at_ms bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RetryWorker(StatefulProcessor):
    """Changes of one fact: those that wait, and the number of the last one applied."""

    def __init__(self, attempt: Attempt, backoff: tuple[float, ...] = BACKOFF_SECONDS, keep_deleted: float = KEEP_DELETED):
        self.attempt, self.backoff, self.keep_deleted = attempt, backoff, keep_deleted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sequence_id bigint, deleted boolean, at_ms bigint")
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for batch in rows for r in batch[["id", "sequence_id", "operation", "payload", "attempts_made", "due_ms", "created_ms"]].itertuples(index=False)]
        yield self._step(key[0], new, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._step(key[0], [], timerValues.getCurrentProcessingTimeInMs())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        last = initialState.sort_values("sequence_id").iloc[-1]
        self.last.update((int(last["sequence_id"]), bool(last["deleted"]), timerValues.getCurrentProcessingTimeInMs()))

    def close(self) -> None:
        pass

    def _step(self, fact: str, new: list[tuple], now: int) -> pd.DataFrame:
        known: dict[str, tuple] = {w[0]: tuple(w) for w in self.waiting.get()}
        for entry in new:  # A change that comes twice waits once.
            known.setdefault(entry[0], entry)
        due = sorted((w for w in known.values() if w[5] <= now), key=lambda w: (w[1], w[0]))
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        if due:
            asked = pd.DataFrame([(w[0], fact, *w[1:5]) for w in due], columns=["id", "memory_id", "sequence_id", "operation", "payload", "attempts_made"])
            for w, told in zip(due, self.attempt(asked).itertuples(index=False), strict=True):
                del known[w[0]]
                name, seq, operation, payload, made, _, created = w
                if told.error is None or pd.isna(told.error):
                    newer = last is None or seq > last[0]
                    if newer:
                        last = (seq, operation == "delete", now)
                    out.append((APPLIED if newer else OLDER, fact, name, seq, operation, payload, made, None, created, now))
                elif told.permanent or made + 1 >= len(self.backoff):
                    out.append((DEAD, fact, name, seq, operation, payload, made + 1, told.error, created, now))
                else:
                    wait = self.backoff[made] * (1 + JITTER_SHARE * max(-1.0, min(1.0, float(told.jitter))))
                    known[name] = (name, seq, operation, payload, made + 1, now + int(wait * 1000), created)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if known:
            self.waiting.put(list(known.values()))
            self.handle.registerTimer(min(w[5] for w in known.values()))
        else:
            self.waiting.clear()
        if last is not None:
            end = last[2] + int(self.keep_deleted * 1000)
            if last[1] and not known and end <= now:
                self.last.clear()
                out.append((FORGOTTEN, fact, None, last[0], None, None, None, None, None, now))
            else:
                self.last.update(last)
                if last[1] and not known:
                    self.handle.registerTimer(end)
        return pd.DataFrame(out, columns=[c.split()[0] for c in SETTLED.split(", ")]).astype({"sequence_id": "Int64", "attempts_made": "Int32", "created_ms": "Int64", "at_ms": "Int64"})


def settled(changes: DataFrame, worker: RetryWorker, start: DataFrame | None = None) -> DataFrame:
    """The stream of settled changes (``SETTLED``) of a stream of queue entries.

    ``start`` (``memory_id, sequence_id, deleted``) is what was applied before. The state needs
    the RocksDB provider, see ``run``.
    """
    millis = lambda c: F.coalesce(F.unix_millis(c), F.lit(0)).alias
    rows = changes.select("memory_id", "id", "sequence_id", "operation", "payload", "attempts_made", millis("next_attempt_at")("due_ms"), millis("created_at")("created_ms"))
    known = None if start is None else start.select("memory_id", "sequence_id", "deleted").groupBy("memory_id")
    return rows.groupBy("memory_id").transformWithStateInPandas(worker, SETTLED, "Append", "ProcessingTime", known)


def run(changes: DataFrame, worker: RetryWorker, folder: str, checkpoint: str, start: DataFrame | None = None, every: str = "1 second") -> StreamingQuery:
    """Starts the worker; settled changes are added to ``folder``, each once, also when a run is taken up again.

    A run that is taken up again would wait for new data before it looks at its timers, so the
    changes are joined by a clock whose rows are left out at once.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load().where("value < 0")
    beats = clock.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in changes.schema.fields])
    return settled(changes.unionByName(beats), worker, start).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()


def read_settled(spark, folder: str) -> DataFrame:
    return spark.read.schema(SETTLED).parquet(folder)


def state_of(rows: DataFrame) -> DataFrame:
    """``memory_id, payload, sequence_id, deleted`` as the batch form keeps it, from the settled changes."""
    last = rows.where(F.col("kind") == APPLIED).groupBy("memory_id").agg(F.max(F.struct("sequence_id", "operation", "payload")).alias("l"))
    gone = F.col("l.operation") == "delete"
    return last.select("memory_id", F.when(~gone, F.col("l.payload")).alias("payload"), F.col("l.sequence_id").alias("sequence_id"), gone.alias("deleted"))


def dead_letters_of(rows: DataFrame) -> DataFrame:
    """The dead letters; a change that came again after its death is one."""
    w = Window.partitionBy("id").orderBy("at_ms")
    dead = rows.where(F.col("kind") == DEAD).withColumn("_turn", F.row_number().over(w)).where("_turn = 1")
    return dead.select("id", "memory_id", F.col("operation").alias("failed_operation"), F.col("error").alias("failure_reason"), "attempts_made", "payload", "sequence_id", F.timestamp_millis("created_ms").alias("first_failed_at"), F.timestamp_millis("at_ms").alias("last_attempted_at"))


def drained(query: StreamingQuery, spark, folder: str, entries: int, seconds: float) -> DataFrame:
    """Waits until ``entries`` changes are settled and stops the query; raises after ``seconds``."""
    end = time.time() + seconds
    try:
        while time.time() < end:
            if query.exception() is not None:
                raise query.exception()
            rows = read_settled(spark, folder) if query.lastProgress else None
            if rows is not None and rows.where("id is not null").select("id").distinct().count() >= entries:
                return rows
            time.sleep(0.5)
    finally:
        query.stop()
    raise TimeoutError(f"fewer than {entries} changes settled in {seconds} seconds")
