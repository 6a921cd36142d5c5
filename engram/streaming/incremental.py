"""Incremental runs: a change feed as a stream, and the watermark of the last full run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators.outbox import apply_changes
from engram.sources.shared import materialise


def change_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Queue files of a folder as a stream, a file a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def apply_stream(changes: DataFrame, start: DataFrame, checkpoint: str, publish: Callable[[DataFrame], None]) -> None:
    """Applies all changes that are there to a table and publishes each new state.

    Each micro-batch is folded into the last written state; a batch that is repeated after a
    failure changes nothing, as only newer sequence numbers win.
    """
    state = {"table": materialise(start, "outbox-state")}

    def fold(batch: DataFrame, _: int) -> None:
        state["table"] = materialise(apply_changes(state["table"], batch), "outbox-state")
        publish(state["table"])

    changes.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(fold).start().awaitTermination()


def run_since(memories: DataFrame, watermark: DataFrame | None) -> DataFrame:
    """The facts a run starts from: those created at or after the last full run's start."""
    since = None if watermark is None else watermark.select("last_run_started_at").first()
    return memories if since is None or since[0] is None else memories.where(F.col("created_at") >= F.lit(since[0]))
