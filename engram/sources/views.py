"""The store's tables as deterministic views over the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.clock import as_rfc3339
from engram.sources.shared import table

#: 2025-01-01T00:00:00Z, and the point in time that queries take for now.
EPOCH = 1_735_689_600
NOW = EPOCH + 200 * 86_400
DAY = 86_400


def key(column: str) -> Column:
    """A number as a string id whose text order is its numeric order."""
    return F.lpad(F.col(column).cast("string"), 12, "0")


def at(seconds: Column | int) -> Column:
    return F.timestamp_seconds(F.lit(seconds) if isinstance(seconds, int) else seconds)


def now() -> Column:
    return at(NOW)


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as facts: scope from the language, lifecycle from the id."""
    d = F.col("doc_id")
    created = F.lit(EPOCH) + d * 60
    nothing = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(
        key("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.when(d % 3 == 0, "episodic").when(d % 3 == 1, "semantic").otherwise("procedural").alias("memory_type"),
        F.when(d % 19 == 0, nothing).otherwise(F.col("source")).alias("source_agent"),
        F.col("lang").alias("boundary"),
        at(created).alias("created_at"),
        at(created - (d % 30) * DAY).alias("valid_from"),
        F.when(d % 11 == 0, at(created + (d % 5) * 90 * DAY)).alias("valid_until"),
        (0.5 + (d % 50) / 100.0).cast("float").alias("confidence"),
        (d % 7).alias("access_count"),
        at(created - (d % 500) * DAY).alias("last_accessed"),
        F.when(d % 13 == 0, F.lpad((d + 1).cast("string"), 12, "0")).alias("superseded_by"),
        F.when(d % 17 == 0, at(created + 10 * DAY)).alias("archived_at"),
        # Some markers are malformed: no time at all, or a bare number.
        F.when(d % 70 == 0, '{"decay":{"last_decay_at":"not a time"}}')
        .when(d % 110 == 0, '{"decay":{"last_decay_at":1700000000}}')
        .when(d % 10 == 0, F.concat(F.lit('{"decay":{"last_decay_at":"'), as_rfc3339(at(created - (d % 400) * DAY)), F.lit('"}}')))
        .otherwise("{}")
        .alias("metadata_json"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as the vector table; scope by id."""
    scope = F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "es", "fr")]), (F.col("vec_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(key("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), scope.alias("boundary"), "label")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers, nations and regions as graph nodes scoped by region."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    scope = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.translate(F.lower("r_name"), " ", "_").alias("boundary"))
    person = table(spark, sf_dir, "customer").join(scope, F.col("c_nationkey") == F.col("n_nationkey"))
    maker = table(spark, sf_dir, "supplier").join(scope, F.col("s_nationkey") == F.col("n_nationkey"))
    own = nation.join(scope, "n_nationkey")
    made = [
        person.select(F.concat(F.lit("c"), key("c_custkey")).alias("id"), F.col("c_name").alias("name"), F.lit("person").alias("entity_type"), "boundary"),
        maker.select(F.concat(F.lit("s"), key("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.lit("organization").alias("entity_type"), "boundary"),
        own.select(F.concat(F.lit("n"), key("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.lit("location").alias("entity_type"), "boundary"),
        region.select(F.concat(F.lit("r"), key("r_regionkey")).alias("id"), F.col("r_name").alias("name"), F.lit("location").alias("entity_type"), F.translate(F.lower("r_name"), " ", "_").alias("boundary")),
    ]
    whole = made[0]
    for part in made[1:]:
        whole = whole.unionByName(part)
    return whole.withColumn("created_at", at(EPOCH))


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges customer/supplier → nation → region; some customers' edges are closed."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    scope = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.translate(F.lower("r_name"), " ", "_").alias("boundary"))
    n, c, s = F.concat(F.lit("n"), key("n_nationkey")), F.concat(F.lit("c"), key("c_custkey")), F.concat(F.lit("s"), key("s_suppkey"))
    person = table(spark, sf_dir, "customer").join(scope, F.col("c_nationkey") == F.col("n_nationkey"))
    maker = table(spark, sf_dir, "supplier").join(scope, F.col("s_nationkey") == F.col("n_nationkey"))
    own = nation.join(scope, "n_nationkey")
    shut = F.when(F.col("c_custkey") % 9 == 0, at(EPOCH + 50 * DAY))
    open_ = F.lit(None).cast("timestamp")
    made = [
        person.select(c.alias("from_entity_id"), n.alias("to_entity_id"), F.lit("in_nation").alias("relation_type"), "boundary", shut.alias("valid_until"), key("c_custkey").alias("source_memory_id")),
        maker.select(s.alias("from_entity_id"), n.alias("to_entity_id"), F.lit("in_nation").alias("relation_type"), "boundary", open_.alias("valid_until"), key("s_suppkey").alias("source_memory_id")),
        own.select(n.alias("from_entity_id"), F.concat(F.lit("r"), key("n_regionkey")).alias("to_entity_id"), F.lit("in_region").alias("relation_type"), "boundary", open_.alias("valid_until"), key("n_nationkey").alias("source_memory_id")),
    ]
    whole = made[0]
    for part in made[1:]:
        whole = whole.unionByName(part)
    return whole.select(F.concat_ws(">", "from_entity_id", "to_entity_id").alias("id"), "*", at(EPOCH).alias("valid_from"), F.lit(0.9).alias("confidence"))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages and one scope that no fact uses."""
    return spark.createDataFrame([(b, f"facts in {b}") for b in ("de", "en", "es", "fr", "unused")], "name string, description string").withColumn("created_at", at(EPOCH))


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a change queue on facts: sequence, operation, attempts, due time."""
    e, kind = F.col("event_id"), F.col("event_type")
    operation = F.when(kind == "error", "delete").when(kind == "signup", "write").otherwise("update")
    return table(spark, sf_dir, "events").select(
        key("event_id").alias("id"),
        key("user_id").alias("memory_id"),
        operation.alias("operation"),
        F.col("props").alias("payload"),
        e.alias("sequence_id"),
        (e % 10).cast("int").alias("attempts_made"),
        at(F.lit(EPOCH) + (e * 7919) % 1_000_000).alias("next_attempt_at"),
        at(F.lit(EPOCH) + e).alias("created_at"),
        F.lit(None).cast("string").alias("last_error"),
    )
