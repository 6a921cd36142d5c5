"""Dense numbers over a total order without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.sources.shared import materialise

RANGE = "_range"


def numbered(rows: DataFrame, order: list[str], name: str, start: Column | int = 0) -> DataFrame:
    """``rows`` with ``name``: 0, 1, 2 … from ``start`` on in ``order``, which must be total.

    Rows are dealt into ranges of the order and written, so that both the counts and the
    numbers come from the same ranges. A range's first number is the sum of the counts
    before it; that sum runs over one row a range. An empty table stays empty.
    """
    dealt = materialise(rows.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select(RANGE, before.alias("_before"))
    turn = F.row_number().over(Window.partitionBy(RANGE).orderBy(*order)) - 1
    start = F.lit(start) if isinstance(start, int) else start
    return dealt.withColumn("_turn", turn).join(F.broadcast(first), RANGE).withColumn(name, (start + F.col("_before") + F.col("_turn")).cast("bigint")).drop(RANGE, "_turn", "_before")
