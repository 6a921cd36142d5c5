"""Hash-chained audit log.

Each event's hash covers its stored predecessor's hash and its own canonical JSON, so a
chain is verified row by row in parallel; only the link to the predecessor needs an order.
SHA-256 takes the place of a hash that Spark does not have.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from engram.functions.jsons import audit_body
from engram.operators.numbering import RANGE
from engram.sources.shared import drop, materialise, shared_path

GENESIS = "0" * 64
#: Events, and bytes of their bodies, of one range of ``seal``.
SEAL_EVENTS = 250_000
SEAL_BYTES = 128 << 20


def event_hash(previous: Column, body: Column) -> Column:
    return F.sha2(F.concat(previous, body).cast("binary"), 256)


def _folded(last: str, bodies: pa.Array) -> Iterator[tuple[str, str]]:
    """Previous and own hash of each body, from the hash ``last`` on."""
    for body in bodies.to_pylist():
        before, last = last, hashlib.sha256((last + body).encode("utf-8")).hexdigest()
        yield before, last


def seal(events: DataFrame, previous: str = GENESIS) -> DataFrame:
    """Adds ``prev_event_hash`` and ``event_hash`` in order of ``seq``.

    A chain is sequential by nature, but no task needs more than a stretch of it. Events are
    dealt by ``seq`` into ranges of about ``SEAL_EVENTS`` and written. One small task after the
    other folds the bodies of a range and hands on its last hash alone; then all ranges are
    hashed in parallel, each from the hash before it.
    """
    spark = events.sparkSession
    bodies = events.withColumn("_body", audit_body())
    n, size = bodies.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_body")), F.lit(0))).first()
    ranges = max(1, math.ceil(n / SEAL_EVENTS), math.ceil(size / SEAL_BYTES))
    dealt = bodies.repartitionByRange(ranges, "seq").withColumn(RANGE, F.spark_partition_id())
    path = shared_path(spark, "audit-ranges")
    dealt.sortWithinPartitions(RANGE, "seq").write.option("compression", "zstd").partitionBy(RANGE).parquet(path)
    # The column of the folders comes last.
    written = spark.read.schema(dealt.schema).parquet(path)

    def last_hash(last: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            end = last
            for batch in batches:
                for _, end in _folded(end, batch.column("_body")):
                    pass
            yield pa.RecordBatch.from_arrays([pa.array([end])], names=["last"])

        return run

    starts, last = {}, previous
    for r in sorted(r[RANGE] for r in written.select(RANGE).distinct().collect()):
        starts[r] = last
        own = written.where(F.col(RANGE) == r).select("seq", "_body").coalesce(1).sortWithinPartitions("seq")
        last = own.mapInArrow(last_hash(last), "last string").first()[0]

    schema = StructType(events.schema.fields + [StructField("prev_event_hash", StringType()), StructField("event_hash", StringType())])
    kept = events.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last = None, previous
        for batch in batches:
            places = batch.column(RANGE).to_numpy()
            for lo, hi in pairwise(np.r_[0, np.flatnonzero(np.diff(places)) + 1, len(places)].tolist()):
                if lo == hi:
                    continue
                if places[lo] != here:
                    here = int(places[lo])
                    last = starts[here]
                part = batch.slice(lo, hi - lo)
                before, after = zip(*_folded(last, part.column("_body")))
                last = after[-1]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(before), pa.array(after)], names=schema.names)

    sealed = materialise(written.repartitionById(ranges, RANGE).sortWithinPartitions(RANGE, "seq").mapInArrow(fold, schema), "audit-sealed")
    drop(written)
    return sealed


def verify(log: DataFrame, previous: str = GENESIS) -> DataFrame:
    """``seq, fault``: events whose hash or link to the event before is wrong.

    The link is found by an equi-join on the sequence number of the predecessor, so a log of
    any length is verified in parallel; gaps in the numbers show as broken links.
    """
    first = log.agg(F.min("seq")).first()[0]
    checked = log.select("seq", "prev_event_hash", "event_hash", (event_hash(F.col("prev_event_hash"), audit_body()) != F.col("event_hash")).alias("altered"))
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("event_hash").alias("linked"))
    joined = checked.join(before, "seq", "left").withColumn("linked", F.when(F.col("seq") == F.lit(first), F.lit(previous)).otherwise(F.col("linked")))
    fault = F.when(~F.col("prev_event_hash").eqNullSafe(F.col("linked")), "broken link").when(F.col("altered"), "altered event")
    return joined.withColumn("fault", fault).where(F.col("fault").isNotNull()).select("seq", "fault")


def listing(log: DataFrame, limit: int | None = None) -> DataFrame:
    rows = log.orderBy("seq")
    return rows if limit is None else rows.limit(limit)
