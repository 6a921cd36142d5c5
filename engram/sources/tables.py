"""Writes as copy-on-write: each takes the table's rows and returns the new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.sources.shared import exists

CHECKPOINTS_KEPT = 7
ALIAS_RELATIONS = ("same_as", "alias_for")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of the same key, the rest is kept. Keys in ``changes`` are unique."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def upsert_latest(table: DataFrame, changes: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Upsert of a change list in which the highest ``sequence`` of a key wins."""
    w = Window.partitionBy(*keys).orderBy(F.col(sequence).desc())
    last = changes.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") == 1).select(*table.columns)
    return upsert(table, last, keys)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is in ``keys`` go; a missing key is no error."""
    return table.join(keys, keys.columns, "left_anti")


def delete_report(table: DataFrame, keys: DataFrame) -> DataFrame:
    """For each key whether there was a row to delete."""
    there = table.select(*keys.columns).distinct().withColumn("deleted", F.lit(True))
    return keys.distinct().join(there, keys.columns, "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The new table, and the rows of ``rows`` that were new. Existing keys are left alone."""
    fresh = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh.select(*table.columns)), fresh


def update_rows(table: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Full-row update by key, and the keys of ``changes`` that were not found."""
    missing = changes.select(key).join(table.select(key), key, "left_anti")
    known = changes.join(table.select(key), key, "left_semi")
    return upsert(table, known.select(*table.columns), [key]), missing


def edit_memory(memories: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """User edits (``id, content, memory_type, boundary, confidence``): other fields stay, an archived fact comes back."""
    new = edits.select("id", *[F.col(c).alias(f"new_{c}") for c in ("content", "memory_type", "boundary", "confidence")], F.lit(True).alias("_hit"))
    joined = memories.join(new, "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    columns = {c: F.when(hit, F.coalesce(f"new_{c}", c)).otherwise(F.col(c)) for c in ("content", "memory_type", "boundary", "confidence")}
    columns["last_accessed"] = F.when(hit, now).otherwise(F.col("last_accessed"))
    columns["archived_at"] = F.when(~hit, F.col("archived_at"))
    return joined.select(*[columns.get(c, F.col(c)).alias(c) for c in memories.columns])


def new_entities(entities: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities to add, and those refused because name, type and boundary exist already (in the table or before in ``rows``)."""
    keys = ["name", "entity_type", "boundary"]
    w = Window.partitionBy(*keys).orderBy("id")
    numbered = rows.withColumn("_turn", F.row_number().over(w)).join(entities.select(*keys).distinct().withColumn("_there", F.lit(True)), keys, "left")
    ok = F.col("_there").isNull() & (F.col("_turn") == 1)
    return numbered.where(ok).select(*rows.columns), numbered.where(~ok).select(*rows.columns)


def new_relationships(entities: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges to add (scope of the ``from`` entity), and refused ones with a ``reason``.

    Both ends must exist, and only alias relations may cross scopes.
    """
    ends = entities.select("id", F.col("boundary").alias("b"))
    joined = rows.drop("boundary").join(ends.select(F.col("id").alias("from_entity_id"), F.col("b").alias("from_b")), "from_entity_id", "left")
    joined = joined.join(ends.select(F.col("id").alias("to_entity_id"), F.col("b").alias("to_b")), "to_entity_id", "left")
    crossing = (F.col("from_b") != F.col("to_b")) & ~F.col("relation_type").isin(*ALIAS_RELATIONS)
    judged = joined.withColumn("reason", F.when(F.col("from_b").isNull() | F.col("to_b").isNull(), "missing endpoint").when(crossing, "crosses boundaries"))
    judged = judged.withColumn("boundary", F.col("from_b")).drop("from_b", "to_b")
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def supersede_relationships(relationships: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Close an open edge when its successor starts: ``changes`` are new edges with ``old_id``.

    Returns the new table and the changes refused because the old edge is missing, closed,
    or starts after its successor.
    """
    old = relationships.select(F.col("id").alias("old_id"), F.col("valid_from").alias("old_from"), F.col("valid_until").alias("old_until"), F.lit(True).alias("_there"))
    judged = changes.join(old, "old_id", "left")
    ok = F.coalesce(F.col("_there") & F.col("old_until").isNull() & (F.col("old_from") <= F.col("valid_from")), F.lit(False))
    good = judged.where(ok)
    ends = good.groupBy(F.col("old_id").alias("id")).agg(F.min("valid_from").alias("_end"))
    closed = relationships.join(ends, "id", "left").withColumn("valid_until", F.coalesce("valid_until", "_end")).select(*relationships.columns)
    return closed.unionByName(good.select(*relationships.columns)), judged.where(~ok).select(*changes.columns)


def retire_edges(relationships: DataFrame, memory_ids: DataFrame, now: Column) -> DataFrame:
    """Open edges that stem from the given facts (``source_memory_id``) end now; ``retired`` marks them."""
    hit = memory_ids.select("source_memory_id").distinct().withColumn("_hit", F.lit(True))
    joined = relationships.join(hit, "source_memory_id", "left").withColumn("retired", F.col("_hit").isNotNull() & F.col("valid_until").isNull())
    return joined.withColumn("valid_until", F.when(F.col("retired"), now).otherwise(F.col("valid_until"))).select(*relationships.columns, "retired")


def keep_latest(rows: DataFrame, keys: list[str], kept: int, *order: Column) -> DataFrame:
    """The first ``kept`` rows of each key (of the whole table without keys) in the given order."""
    if not keys:
        return rows.orderBy(*order).limit(kept)
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= kept).drop("_turn")


def set_watermark(spark, started_at) -> DataFrame:
    """The one-row table that holds the start of the last full run."""
    return spark.createDataFrame([(1,)], "id int").select("id", F.lit(started_at).cast("timestamp").alias("last_run_started_at"))


def register_agent(tokens: DataFrame, agent: DataFrame) -> DataFrame:
    return tokens.unionByName(agent.select(*tokens.columns))


def set_agent_boundaries(tokens: DataFrame, agent_name: str, boundaries: list[str]) -> DataFrame:
    mine = (F.col("agent_name") == agent_name) & F.col("revoked_at").isNull()
    return tokens.withColumn("boundaries", F.when(mine, F.array(*[F.lit(b) for b in boundaries]).cast("array<string>")).otherwise(F.col("boundaries")))


def revoke_agent(tokens: DataFrame, agent_name: str, now: Column) -> DataFrame:
    mine = (F.col("agent_name") == agent_name) & F.col("revoked_at").isNull()
    return tokens.withColumn("revoked_at", F.when(mine, now).otherwise(F.col("revoked_at")))


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON folder a boundary; replaced as a whole."""
    reports.write.mode("overwrite").partitionBy("boundary").json(path)


def read_reports(spark, path: str, schema) -> DataFrame:
    """The reports under ``path``; a missing folder has none, and a malformed report is left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_snapshot(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)
