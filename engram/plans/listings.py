"""Scans, filters, listings, statistics and table writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions.clock import as_of, staleness
from engram.operators import divergence, scope
from engram.plans import sql as S
from engram.plans.register import Register
from engram.sources import tables, views
from engram.sources.schema import validate_memories
from engram.sources.shared import table
from engram.sources.views import DAY, EPOCH, NOW

REGISTER = Register()
seconds = F.unix_seconds


@REGISTER(f"WITH {S.MEMORIES} SELECT id, boundary, memory_type, created FROM memories WHERE boundary = 'en' AND memory_type = 'semantic' AND {S.LISTED} AND created >= {EPOCH + 6000} AND coalesce(ends > {NOW}, true)")
def list_memories(spark, d):
    by = scope.ListFilter("en", "semantic", created_since=views.at(EPOCH + 6000), valid_at=views.now())
    return scope.list_memories(views.memories(spark, d), by).select("id", "boundary", "memory_type", seconds("created_at").alias("created"))


@REGISTER(f"WITH {S.MEMORIES} SELECT id, confidence, created FROM memories WHERE {S.LISTED} ORDER BY created DESC, id LIMIT 25")
def list_newest_page(spark, d):
    return scope.list_memories(views.memories(spark, d), scope.ListFilter(), 25).select("id", "confidence", seconds("created_at").alias("created"))


@REGISTER(f"WITH {S.MEMORIES} SELECT id, ends FROM memories WHERE superseded_by IS NULL AND coalesce(ends > {EPOCH + 100 * DAY}, true)")
def point_in_time(spark, d):
    by = scope.ListFilter(include_archived=True, valid_at=views.at(EPOCH + 100 * DAY))
    return scope.list_memories(views.memories(spark, d), by).select("id", seconds("valid_until").alias("ends"))


@REGISTER(
    f"WITH {S.MEMORIES} SELECT boundary, count(*) FILTER ({S.LISTED}) AS listed, count(*) FILTER ({S.SEMANTIC}) AS semantic, count(*) FILTER ({S.KEYWORD}) AS keyword, "
    f"count(*) FILTER ({S.ACTIVE}) AS graph, count(*) FILTER ({S.ACTIVE}) AS consolidation FROM memories GROUP BY boundary"
)
def lifecycle_counts(spark, d):
    now = views.now()
    kinds = {"listed": scope.listed(), "semantic": scope.semantic_active(now), "keyword": scope.keyword_active(now), "graph": scope.graph_current(), "consolidation": scope.consolidation_active()}
    return views.memories(spark, d).groupBy("boundary").agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])


@REGISTER(
    f"WITH {S.MEMORIES}, b AS (SELECT unnest(['de', 'en', 'es', 'fr', 'unused']) AS name) SELECT name, 'facts in ' || name AS description, "
    f"count(id) AS memory_count FROM b LEFT JOIN memories ON boundary = name AND {S.LISTED} GROUP BY name"
)
def boundary_stats(spark, d):
    return scope.boundary_stats(views.boundaries(spark, d), views.memories(spark, d)).select("name", "description", "memory_count")


@REGISTER(f"WITH {S.MEMORIES} SELECT boundary AS name, min(created) AS created FROM memories GROUP BY boundary")
def boundary_backfill(spark, d):
    return scope.boundary_backfill(views.memories(spark, d)).select("name", seconds("created_at").alias("created"))


@REGISTER(f"WITH {S.MEMORIES} SELECT count(*) AS total FROM memories WHERE {S.LISTED}")
def total_count(spark, d):
    return scope.boundary_stats(views.boundaries(spark, d), views.memories(spark, d)).agg(F.sum("memory_count").alias("total"))


@REGISTER(f"WITH {S.MEMORIES} SELECT boundary, array_to_string(list_sort(list(id)), ',') AS ids FROM memories WHERE {S.ACTIVE} GROUP BY boundary")
def facts_by_boundary(spark, d):
    return scope.by_boundary(views.memories(spark, d)).select("boundary", F.array_join("ids", ",").alias("ids"))


@REGISTER(f"WITH {S.MEMORIES}, w AS (SELECT lpad(CAST(unnest([7, 3, 150, 42, 3]) AS VARCHAR), 12, '0') AS id, unnest([0, 1, 2, 3, 4]) AS p) SELECT id, CAST(min(p) AS INTEGER) AS position, boundary FROM w JOIN memories USING (id) GROUP BY id, boundary")
def batch_lookup(spark, d):
    ids = [f"{n:012d}" for n in (7, 3, 150, 42, 3)] + ["missing"]
    return scope.get_batch(views.memories(spark, d), ids).select("id", "position", "boundary")


@REGISTER(f"WITH {S.MEMORIES} SELECT id, strlen(content) > 5000 AS long FROM memories WHERE trim(content) <> '' AND strlen(content) <= 102400")
def valid_memories(spark, d):
    rows = validate_memories(views.memories(spark, d)).where(F.size("violations") == 0)
    return rows.select("id", (F.octet_length("content") > 5000).alias("long"))


@REGISTER(f"WITH {S.MEMORIES} SELECT id, boundary FROM memories WHERE boundary IN ('de', 'fr')")
def token_authorisation(spark, d):
    rows = [("hash1", "agent a", ["de", "fr"]), ("hash2", "agent b", ["en"])]
    tokens = spark.createDataFrame(rows, "token_hash string, agent_name string, boundaries array<string>").withColumn("revoked_at", F.lit(None).cast("timestamp"))
    tokens = tables.revoke_agent(tokens, "agent b", views.now())
    return scope.authorised(views.memories(spark, d), tokens, "hash1").union(scope.authorised(views.memories(spark, d), tokens, "hash2")).select("id", "boundary")


@REGISTER("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS full_s, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day_s, CAST(NULL AS BIGINT) AS bad_s FROM events")
def as_of_parsing(spark, d):
    e = table(spark, d, "events")
    full = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return e.select("event_id", seconds(as_of(full)).alias("full_s"), seconds(as_of(F.date_format("ts", "yyyy-MM-dd"))).alias("day_s"), seconds(as_of(F.lit("12 May"))).alias("bad_s"))


@REGISTER(f"WITH {S.VECTORS} SELECT boundary, count(*) AS vectors, count(*) FILTER (len(e) = 64) AS sound FROM vectors GROUP BY boundary")
def vector_counts(spark, d):
    return views.vectors(spark, d).groupBy("boundary").agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.size("embedding") == 64).alias("sound"))


@REGISTER(f"WITH {S.MEMORIES}, {S.VECTORS}, x AS (SELECT 'vectors' AS missing_in, id FROM memories ANTI JOIN vectors USING (id) UNION ALL SELECT 'memories', id FROM vectors ANTI JOIN memories USING (id)) SELECT missing_in, count(*) AS n, min(id) AS first_id FROM x GROUP BY missing_in")
def divergence_missing(spark, d):
    rows = divergence.all_missing(views.memories(spark, d), views.vectors(spark, d))
    return rows.groupBy("missing_in").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@REGISTER("SELECT (SELECT count(*) FROM documents) AS memories, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents) <> (SELECT count(*) FROM embeddings) AS differ")
def divergence_counts(spark, d):
    return divergence.count_check(views.memories(spark, d), views.vectors(spark, d))


@REGISTER(
    f"WITH {S.VECTORS} SELECT id, CAST(round(e[1], 5) AS DOUBLE) AS first_value, boundary FROM vectors WHERE n % 7 <> 0 UNION ALL SELECT id, 1.0, 'moved' FROM vectors WHERE n % 7 = 0 "
    f"UNION ALL SELECT '9' || id, 1.0, 'moved' FROM vectors WHERE n % 7 = 0"
)
def vector_upsert(spark, d):
    v = views.vectors(spark, d).drop("label")
    hit = v.where(F.col("id").cast("bigint") % 7 == 0).select("id", F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit("moved").alias("boundary"))
    fresh = hit.withColumn("id", F.concat(F.lit("9"), "id"))
    return tables.upsert(v, hit.unionByName(fresh), ["id"]).select("id", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first_value"), "boundary")


@REGISTER(f"WITH {S.MEMORIES} SELECT count(*) AS rows, count(*) FILTER (n % 5 = 0) AS gone_left FROM memories WHERE n % 5 <> 0")
def delete_rows(spark, d):
    m = views.memories(spark, d)
    kept = tables.delete(m, m.where(F.col("id").cast("bigint") % 5 == 0).select("id").union(spark.createDataFrame([("none",)], "id string")))
    return kept.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("id").cast("bigint") % 5 == 0).alias("gone_left"))


@REGISTER(f"WITH {S.MEMORIES}, x AS (SELECT DISTINCT boundary AS name FROM memories) SELECT name, name NOT IN ('en', 'de') AS created FROM x")
def insert_boundaries(spark, d):
    known = spark.createDataFrame([("en",), ("de",)], "name string")
    asked = views.memories(spark, d).select(F.col("boundary").alias("name"))
    whole, fresh = tables.insert_missing(known, asked, ["name"])
    return whole.join(fresh.select("name", F.lit(True).alias("created")), "name", "left").select("name", F.coalesce("created", F.lit(False)).alias("created"))


@REGISTER(f"WITH {S.MEMORIES} SELECT id, CASE WHEN n % 10 = 0 THEN 'edited' ELSE memory_type END AS memory_type, CASE WHEN n % 10 = 0 THEN NULL ELSE archived END AS archived, CASE WHEN n % 10 = 0 THEN {NOW} ELSE used END AS used, superseded_by FROM memories")
def edit_memories(spark, d):
    m = views.memories(spark, d)
    edits = m.where(F.col("id").cast("bigint") % 10 == 0).select("id", "content", F.lit("edited").alias("memory_type"), "boundary", "confidence")
    made = tables.edit_memory(m, edits, views.now())
    return made.select("id", "memory_type", seconds("archived_at").alias("archived"), seconds("last_accessed").alias("used"), "superseded_by")


@REGISTER(f"WITH {S.MEMORIES} SELECT boundary, id FROM (SELECT boundary, id, row_number() OVER (PARTITION BY boundary ORDER BY created DESC, id DESC) AS t FROM memories) WHERE t <= 7")
def retention(spark, d):
    return tables.keep_latest(views.memories(spark, d), ["boundary"], tables.CHECKPOINTS_KEPT, F.col("created_at").desc(), F.col("id").desc()).select("boundary", "id")


@REGISTER("SELECT event_id, CASE WHEN a < 0 OR a >= 604800 THEN 'critical' WHEN a >= 259200 THEN 'warning' WHEN a >= 86400 THEN 'info' ELSE 'ok' END AS level FROM (SELECT event_id, (event_id * 1009) % 800000 - 5000 AS a FROM events)")
def report_staleness(spark, d):
    age = F.col("event_id") * 1009 % 800_000 - 5_000
    return table(spark, d, "events").select("event_id", staleness(views.at(F.lit(NOW) - age), views.now()).alias("level"))
