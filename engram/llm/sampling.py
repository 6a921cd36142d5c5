"""Bounded, repeatable samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; the fold of a null id is that of ``""``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)).cast("int")


HELD_OUT = 2
#: Longest text that is fitted on, and most bytes of text of a whole sample.
MOST_TEXT_BYTES = 1 << 20
MOST_SAMPLE_BYTES = 64 << 20
_TURNS = 1 << 40


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == HELD_OUT


def turn(doc_id: Column) -> Column:
    """A hash of the id by which samples are drawn."""
    return F.pmod(F.xxhash64(doc_id), F.lit(_TURNS))


def by_class(rows: DataFrame, target: str, most: int, learn_all: bool = False) -> DataFrame:
    """About ``most`` ids (``doc_id``, ``target``) of each class: those whose hash lies under the class's share.

    Rows with a null target or id and, unless ``learn_all``, rows of the held-out fold are
    left out. An id is drawn or not whatever stands beside it, so there is no order to
    establish; the number drawn differs from ``most`` by a few times its square root. Classes
    with fewer rows are taken whole. An id comes once; of conflicting targets the highest counts.
    """
    some = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), target).where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    if not learn_all:
        some = some.where(~held_out(F.col("doc_id")))
    sizes = some.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()
    near = F.lit(False)
    for r in sizes:
        near |= (F.col(target) == F.lit(r[target])) & (turn(F.col("doc_id")) < min(_TURNS, _TURNS * most // r["n"] + 1))
    return some.where(near).groupBy("doc_id").agg(F.max(target).alias(target))


def texts_of(documents: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """``doc_id``, ``columns`` (the first is the text) and the other columns of ``ids``, a row an id, bounded in bytes.

    Texts of more than ``MOST_TEXT_BYTES`` are left out, and what goes beyond
    ``MOST_SAMPLE_BYTES`` in the order of the ids' hash. Of rows with one id the least is taken.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), *columns)
    size = F.coalesce(F.octet_length(columns[0]), F.lit(0))
    found = docs.where(size <= MOST_TEXT_BYTES).join(F.broadcast(ids), "doc_id")
    others = [c for c in ids.columns if c != "doc_id"]
    one = found.groupBy("doc_id", *others).agg(F.min(F.struct(*columns)).alias("row")).select("doc_id", *others, "row.*")
    told = one.withColumn("bytes", F.sum(size).over(Window.orderBy(turn(F.col("doc_id")), "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    return told.where(F.col("bytes") <= MOST_SAMPLE_BYTES).drop("bytes")
