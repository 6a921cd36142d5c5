"""Vector, keyword and fused retrieval over the facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.operators import bm25, cells, evaluate, knn, retrieval, vector_graph
from engram.plans import sql as S
from engram.plans.register import Register
from engram.sources import views
from engram.sources.shared import materialise, table
from engram.sources.views import NOW

REGISTER = Register()
PAGE = 10
#: The driver's unit vectors are nearly orthogonal, so floors are lower here than in production.
FLOOR = 0.30


def _scopes(q: Column) -> Column:
    return F.when(q % 2 == 0, F.array(F.lit("en"), F.lit("de"))).otherwise(F.array(F.lit("es"), F.lit("fr"), F.lit("en")))


def vector_queries(spark, d):
    """Every vector whose id is divisible by 20."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"), _scopes(F.col("vec_id") / 20).alias("scopes"))


def text_queries(spark, d):
    """Every benchmark item: its text, and the vector of the same number."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return table(spark, d, "benchmark").join(v, "item_id").select(F.col("item_id").alias("query_id"), "text", "embedding", _scopes(F.col("item_id")).alias("scopes"))


_VQ = f"vq AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e, {S.scopes('(vec_id // 20)')} AS scopes FROM embeddings WHERE vec_id % 20 = 0)"
_TQ = f"tq AS (SELECT item_id AS query_id, text, CAST(embedding AS DOUBLE[]) AS e, {S.scopes('item_id')} AS scopes FROM benchmark JOIN embeddings ON vec_id = item_id)"
_SEM = lambda k, src, name: f"{S.knn(k, src, name + '_k')}, {name} AS ({S.ranked(f'SELECT query_id, id, score, created FROM {name}_k JOIN memories USING (id) WHERE {S.SEMANTIC}', k)})"
_KEY = lambda k, name: f"{S.bm25(k, name + '_b')}, {name} AS ({S.ranked(f'SELECT query_id, id, score, created FROM {name}_b JOIN memories USING (id) JOIN tq USING (query_id) WHERE list_contains(scopes, boundary) AND {S.KEYWORD}', k)})"
_BASE = f"{S.MEMORIES}, {S.VECTORS}, {_TQ}, {S.POSTINGS}, {S.ASKED}"
_FUSE = lambda most: f"""{_SEM(200, 'tq', 'sem')}, {_KEY(200, 'kw')},
fused AS ({S.ranked("SELECT query_id, id, coalesce(1.0::DOUBLE / (60 + s.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0) AS score, coalesce(s.created, k.created) AS created FROM sem s FULL JOIN kw k USING (query_id, id)", most)})"""  # noqa: E731
_FUSED = _FUSE(PAGE)
_OUT = "SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM"


def _out(rows):
    return rows.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@REGISTER(f"WITH {S.VECTORS}, {_VQ}, {S.knn(PAGE, 'vq')} {_OUT} knn")
def knn_search(spark, d):
    return _out(knn.knn(vector_queries(spark, d), views.vectors(spark, d), PAGE))


@REGISTER(f"WITH {S.VECTORS}, {_VQ}, {S.knn(PAGE, 'vq')} {_OUT} knn")
def knn_search_ivf(spark, d):
    """Cells first, then every cell that may hold a better vector: nothing is missed."""
    return _out(cells.search(vector_queries(spark, d), cells.build(views.vectors(spark, d)), PAGE, exact=True))


@REGISTER()
def knn_search_probed(spark, d):
    """The cells that a query probes only; tests measure the recall."""
    return _out(cells.search(vector_queries(spark, d), cells.build(views.vectors(spark, d)), PAGE))


@REGISTER()
def knn_search_graph(spark, d):
    """Walks through graphs over 8-bit codes, candidates scored exactly; tests measure the recall."""
    v = views.vectors(spark, d)
    return _out(vector_graph.search(vector_queries(spark, d), vector_graph.build(v), v, PAGE))


@REGISTER(
    f"""WITH {S.VECTORS} SELECT id, boundary, round(CASE WHEN n % 4 = 0 THEN -e[1] ELSE e[1] END, 5) AS first FROM vectors WHERE n % 3 <> 0"""
)
def ivf_index_upkeep(spark, d):
    """Rows of the index after every third vector was deleted and every fourth written again as its opposite."""
    v, n = views.vectors(spark, d), F.col("id").cast("bigint")
    changed = v.where((n % 4 == 0) & (n % 3 != 0)).withColumn("embedding", F.transform("embedding", lambda x: -x))
    rows = cells.upsert(cells.build(v), changed, v.where(n % 3 == 0)).rows
    return rows.select("id", "boundary", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@REGISTER()
def knn_self_join_cells(spark, d):
    """``knn_self_join`` within the cells that a vector probes; tests measure the recall."""
    found = cells.neighbours(views.vectors(spark, d), 5, FLOOR)
    return found.select("boundary", "id", "other", F.round("score", 6).alias("score"))


@REGISTER(f"WITH {S.VECTORS}, {S.neighbours(5, FLOOR)} SELECT boundary, id, other, round(score, 6) AS score FROM near")
def knn_self_join(spark, d):
    found = knn.neighbours(views.vectors(spark, d), 5, FLOOR)
    return found.select("boundary", "id", "other", F.round("score", 6).alias("score"))


@REGISTER(f"WITH {S.VECTORS}, {S.neighbours(5, FLOOR)} SELECT DISTINCT boundary, least(id, other) AS a, greatest(id, other) AS b FROM near x WHERE EXISTS (SELECT 1 FROM near y WHERE y.id = x.other AND y.other = x.id)")
def mutual_neighbours(spark, d):
    return knn.mutual(knn.neighbours(views.vectors(spark, d), 5, FLOOR))


@REGISTER(f"WITH {S.MEMORIES}, {S.VECTORS}, {_VQ}, {_SEM(PAGE, 'vq', 'sem')} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, 'rank ' || rank || '/' || count(*) OVER (PARTITION BY query_id) AS explanation FROM sem")
def retrieve_semantic(spark, d):
    rows = retrieval.semantic(vector_queries(spark, d), views.vectors(spark, d), views.memories(spark, d), views.now(), PAGE)
    return retrieval.explained(rows).select("query_id", "id", F.round("score", 6).alias("score"), "rank", "explanation")


@REGISTER(f"WITH {S.MEMORIES}, {S.VECTORS}, {_VQ}, {S.knn(PAGE, 'vq')}, x AS ({S.ranked(f'SELECT query_id, id, score, created FROM knn JOIN memories USING (id) WHERE score >= {FLOOR}', PAGE)}) {_OUT} x")
def retrieve_semantic_archived(spark, d):
    """Archived, superseded and expired facts included, with a score threshold."""
    return _out(retrieval.semantic(vector_queries(spark, d), views.vectors(spark, d), views.memories(spark, d), views.now(), PAGE, FLOOR, True))


def index_of(spark, d) -> bm25.KeywordIndex:
    """The keyword index of a folder's facts, built by each query that searches it."""
    return bm25.build_index(views.memories(spark, d))


@REGISTER(f"WITH {S.MEMORIES}, {S.POSTINGS}, {S.ASKED}, {S.bm25(PAGE)} {_OUT} bm25")
def bm25_search(spark, d):
    return _out(bm25.search(text_queries(spark, d), index_of(spark, d), PAGE))


_RENEWED = f"""{S.MEMORIES.replace("memories AS", "stored AS", 1)},
memories AS (SELECT * REPLACE (CASE WHEN n % 4 = 0 THEN 'renewed ' || coalesce(content, '') ELSE content END AS content) FROM stored WHERE n % 3 <> 0)"""


@REGISTER(f"WITH {_RENEWED}, {S.POSTINGS} SELECT id, CAST(length AS INTEGER) AS length, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY id, length")
def keyword_index_upkeep(spark, d):
    """Postings after every third fact was deleted and every fourth written again."""
    return bm25.postings(_kept_up(spark, d)).groupBy("id", F.col("length").cast("int").alias("length")).agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("total"))


def _kept_up(spark, d):
    m, n = views.memories(spark, d), F.col("id").cast("bigint")
    changed = m.where((n % 4 == 0) & (n % 3 != 0)).withColumn("content", F.concat(F.lit("renewed "), F.coalesce("content", F.lit(""))))
    return bm25.upsert_index(bm25.build_index(m), changed, m.where(n % 3 == 0))


@REGISTER(f"WITH {_RENEWED}, {S.POSTINGS}, {S.ASKED}, {S.bm25(PAGE)} {_OUT} bm25")
def bm25_after_upkeep(spark, d):
    """Search after the same changes: frequencies and lengths are those of the facts that are left, none counted anew."""
    return _out(bm25.search(text_queries(spark, d), _kept_up(spark, d), PAGE))


@REGISTER(f"WITH {_BASE}, {_KEY(PAGE, 'kw')} {_OUT} kw")
def retrieve_keyword(spark, d):
    m = views.memories(spark, d)
    return _out(retrieval.keyword(text_queries(spark, d), index_of(spark, d), m, views.now(), PAGE))


def _hybrid(spark, d, most=PAGE):
    """Queries, the index, fused hits, and the first semantic hits up to the fan-out; vectors are searched once."""
    m = views.memories(spark, d)
    q, index = text_queries(spark, d), index_of(spark, d)
    near = materialise(knn.knn(q, views.vectors(spark, d), retrieval.TOP_EACH), "near")
    whole = retrieval.semantic_of(near, m, views.now(), retrieval.TOP_EACH)
    fused = retrieval.fuse(whole, retrieval.keyword(q, index, m, views.now(), retrieval.TOP_EACH), most)
    return q, index, fused, retrieval.semantic_of(near, m, views.now(), retrieval.FANOUT)


@REGISTER(f"WITH {_BASE}, {_FUSED} {_OUT} fused")
def retrieve_hybrid(spark, d):
    return _out(_hybrid(spark, d)[2])


@REGISTER(f"WITH {_BASE}, {_FUSED} {_OUT} fused WHERE query_id IN (SELECT query_id FROM kw_b_all WHERE score >= 12)")
def retrieve_abstaining(spark, d):
    q, index, rows, _ = _hybrid(spark, d)
    return _out(retrieval.abstaining(rows, q, index, 12.0))


_PAGED = f"{_SEM(20, 'tq', 'sem20')}, {_FUSED.replace('sem', 'sfm').replace('kw', 'kfw')}"
_LOGIT = "CAST((CAST(id AS BIGINT) * 37 + query_id * 11) % 200 - 130 AS DOUBLE) / 25"
_POOLED = lambda fused: f"""{_SEM(20, 'tq', 'sem20')}, {fused.replace('sem', 'sfm').replace('kw', 'kfw')},
place AS (SELECT query_id, id, min(ch * 1000 + rank) AS p FROM (SELECT query_id, {S.KEY.format('query_id * 13 % 200 + n * 3')} AS id, 0 AS ch, n AS rank FROM tq, (VALUES (1), (2)) g(n) UNION ALL SELECT query_id, id, 1, rank FROM sem20 UNION ALL SELECT query_id, id, 2, rank FROM fused) GROUP BY query_id, id),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, id) AS position FROM place),
scored AS (SELECT query_id, id, position, 1 / (1 + exp(-({_LOGIT}))) AS score FROM pool WHERE position <= 40),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank FROM scored WHERE score >= 0.05) WHERE rank <= {PAGE})"""  # noqa: E731
_POOL = _POOLED(_FUSE(retrieval.FANOUT))


def _pooled(spark, d):
    """Queries, semantic hits and the pool of all three channels; the graph channel has two facts a query."""
    q, _, base, hits = _hybrid(spark, d, retrieval.FANOUT)
    n = F.explode(F.array(F.lit(1), F.lit(2))).alias("rank")
    linked = q.select("query_id", n).withColumn("n", F.col("query_id") * 13 % 200 + F.col("rank") * 3).select("query_id", views.key("n").alias("id"), F.lit(0.5).alias("score"), "rank")
    return q, hits, retrieval.pool(base, hits, linked)


def _reranked(spark, d):
    q, hits, pooled = _pooled(spark, d)
    logits = pooled.select("query_id", "id", (((F.col("id").cast("bigint") * 37 + F.col("query_id") * 11) % 200 - 130) / 25.0).alias("logit"))
    return q, hits, retrieval.reranked(pooled, logits, PAGE, 0.05)


@REGISTER(f"WITH {_BASE}, {_POOL} {_OUT} reranked")
def retrieve_reranked(spark, d):
    """Graph, semantic and hybrid hits up to the fan-out reach the reranker; the page is cut after it."""
    return _out(_reranked(spark, d)[2])


@REGISTER(f"WITH {_BASE}, {_POOL} SELECT query_id, id, CAST(position AS INTEGER) AS rank FROM pool")
def retrieve_without_scorer(spark, d):
    """No scorer at hand: the whole pool in its order, nothing cut off at the scorer's batch."""
    pooled = _pooled(spark, d)[2]
    return retrieval.reranked(pooled, None, retrieval.MAX_RESULTS).select("query_id", "id", "rank")


@REGISTER(
    f"""WITH {_BASE}, {_PAGED},
place AS (SELECT query_id, id, min(ch * 1000 + rank) AS p FROM (SELECT query_id, id, 2 AS ch, rank FROM sem20 UNION ALL SELECT query_id, id, 1, rank FROM fused) GROUP BY query_id, id)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p, id) AS INTEGER) AS position FROM place"""
)
def read_candidates(spark, d):
    """Hybrid hits, then the semantic hits that are missing there."""
    _, _, base, hits = _hybrid(spark, d)
    return retrieval.read_pool(base, hits).select("query_id", "id", "position")


_HINTS = f"""top AS (SELECT query_id, max(score) FILTER (rank = 1) AS a, coalesce(max(score) FILTER (rank = 2), 0) AS b FROM reranked GROUP BY query_id),
hints AS (SELECT query_id, CASE WHEN coalesce(a >= 0.5 OR (a > 0 AND a >= 3 * b), false) THEN 'strong' ELSE 'weak' END AS hint, a FROM tq LEFT JOIN top USING (query_id))"""


@REGISTER(f"WITH {_BASE}, {_POOL}, {_HINTS} SELECT query_id, hint FROM hints")
def search_hints(spark, d):
    q, _, rows = _reranked(spark, d)
    return retrieval.search_hint(rows, q)


@REGISTER(f"WITH {_BASE}, {_PAGED} {_OUT} fused WHERE query_id IN (SELECT query_id FROM sem20 WHERE rank = 1 AND score >= {FLOOR})")
def relevance_gate(spark, d):
    _, _, rows, hits = _hybrid(spark, d)
    return _out(retrieval.relevance_gate(rows, hits, FLOOR))


@REGISTER(
    f"""WITH {_BASE}, {_POOL}, {_HINTS}, j AS (SELECT query_id, a IS NULL OR hint = 'weak' OR a < 0.01 AS abstain, coalesce(a, 0) AS a FROM hints)
SELECT query_id, abstain, round(a, 6) AS top_relevance, id, CAST(rank AS INTEGER) AS rank, CASE WHEN id IS NOT NULL THEN 'late ' || (CAST(id AS BIGINT) % 5) END AS topic FROM j LEFT JOIN reranked USING (query_id)"""
)
def structured_read(spark, d):
    q, _, rows = _reranked(spark, d)
    n = F.col("id").cast("bigint") % 5
    ids = rows.select("id").distinct()
    topics = ids.select("id", F.concat(F.lit("early "), n.cast("string")).alias("topic"), views.at(NOW - 9).alias("generated_at")).unionByName(ids.select("id", F.concat(F.lit("late "), n.cast("string")).alias("topic"), views.now().alias("generated_at")))
    made = retrieval.structured_read(rows, q, topics)
    return made.select("query_id", "abstain", F.round("top_relevance", 6).alias("top_relevance"), "id", "rank", "topic")


_REPORTS = f"""rep AS (SELECT * FROM (VALUES ('en', 1, {NOW} - 60, false), ('de', 1, {NOW} - 30 * 3600, true), ('es', 2, {NOW} - 60, false), ('fr', 1, {NOW} - 8 * 86400, true), ('it', 1, {NOW} - 80 * 3600, false), ('pt', 1, {NOW} + 5, true)) t(boundary, version, made, unnamed)),
caller AS (SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 0 THEN ['en'] WHEN 1 THEN ['en', 'de', 'es'] WHEN 2 THEN ['none', 'it', 'fr'] ELSE ['pt', 'en'] END AS scopes FROM customer),
asked AS (SELECT query_id, unnest(scopes) AS boundary, unnest(range(0, len(scopes))) AS position FROM caller),
told AS (SELECT query_id, position, a.boundary, unnest(list_filter([CASE WHEN coalesce(version, 9) > 1 THEN '0report_missing/warn' END, CASE WHEN version = 1 AND made > {NOW} THEN '1clock_skew_detected/critical' END,
  CASE WHEN version = 1 AND made <= {NOW} THEN CASE WHEN {NOW} - made >= 604800 THEN '2report_stale_critical/critical' WHEN {NOW} - made >= 259200 THEN '2report_stale_warn/warn' WHEN {NOW} - made >= 86400 THEN '2report_stale_info/info' END END,
  CASE WHEN version = 1 AND unnamed THEN '3topic_names_unavailable/info' END], lambda x: x IS NOT NULL)) AS w FROM asked a LEFT JOIN rep USING (boundary))"""


def _warnings(spark, d):
    made = [("en", 1, NOW - 60, False), ("de", 1, NOW - 30 * 3600, True), ("es", 2, NOW - 60, False), ("fr", 1, NOW - 8 * 86400, True), ("it", 1, NOW - 80 * 3600, False), ("pt", 1, NOW + 5, True)]
    reports = spark.createDataFrame(made, "boundary string, schema_version int, at long, topic_names_unavailable boolean").withColumn("generated_at", views.at(F.col("at")))
    sets = [F.array(*[F.lit(b) for b in s]) for s in (("en",), ("en", "de", "es"), ("none", "it", "fr"), ("pt", "en"))]
    callers = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.element_at(F.array(*sets), (F.col("c_custkey") % 4 + 1).cast("int")).alias("scopes"))
    return callers, retrieval.report_warnings(callers, reports, views.now())


@REGISTER(f"WITH {_REPORTS} SELECT query_id, CAST(position AS INTEGER) AS position, CAST(w[1] AS INTEGER) AS turn, boundary, split_part(w[2:], '/', 1) AS code, split_part(w, '/', 2) AS severity FROM told")
def read_warnings(spark, d):
    """Reports that are fine, old, from a later time, of a newer layout or missing."""
    return _warnings(spark, d)[1]


@REGISTER(f"WITH {_REPORTS} SELECT query_id, CASE WHEN bool_or(w LIKE '%critical') THEN 'critical' WHEN count(w) > 0 THEN 'degraded' ELSE 'ok' END AS status, count(w) AS warnings FROM caller LEFT JOIN told USING (query_id) GROUP BY query_id")
def read_health(spark, d):
    return retrieval.read_status(*_warnings(spark, d))


@REGISTER(f"WITH {_BASE}, {_POOL} SELECT query_id, round(avg(score), 6) AS mean_score FROM reranked WHERE rank <= 3 GROUP BY query_id")
def mean_of_top_results(spark, d):
    return evaluate.mean_top(_reranked(spark, d)[2], 3).select("query_id", F.round("mean_score", 6).alias("mean_score"))


@REGISTER("SELECT CASE WHEN bool_or(l = 'critical') THEN 'critical' WHEN bool_or(l <> 'ok') THEN 'degraded' ELSE 'ok' END AS overall, count(*) FILTER (l <> 'ok') AS warnings FROM (SELECT CASE WHEN r_regionkey = 4 THEN 'warning' WHEN r_regionkey = 3 THEN 'info' ELSE 'ok' END AS l FROM region)")
def report_health(spark, d):
    age = F.when(F.col("r_regionkey") == 4, 80 * 3600).when(F.col("r_regionkey") == 3, 30 * 3600).otherwise(60)
    reports = table(spark, d, "region").select(F.col("r_name").alias("boundary"), views.at(F.lit(NOW) - age).alias("generated_at"))
    return retrieval.report_health(reports, views.now())
