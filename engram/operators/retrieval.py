"""Retrievers over batches of queries.

``queries`` has ``query_id, text, embedding, scopes`` (array of boundaries). Every result has
``query_id, id, score, rank`` with total order: score, then newer first, then id. What a
score means differs between retrievers, and so does where a threshold applies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.clock import staleness
from engram.functions.text import trimmed
from engram.functions.vector import rrf, sigmoid
from engram.operators import bm25
from engram.operators.knn import knn
from engram.operators.scope import keyword_active, semantic_active

MAX_RESULTS = 200
MAX_QUERY_BYTES = 2048
TOP_EACH = 200
ABSTAIN_BELOW = 1.0
STRONG = 0.5
SEPARATION = 3.0
FANOUT = 20
POOL = 40
COSINE_FLOOR = 0.66
NO_SIGNAL = 0.01


def check_page(max_results: int) -> None:
    if not 1 <= max_results <= MAX_RESULTS:
        raise ValueError(f"max_results must be within 1 and {MAX_RESULTS}")


def check_query(text: str, max_results: int, to_embed: bool = True) -> None:
    """Reject an empty or over-long query and a page size out of range.

    A text ``to_embed`` must not hold ASCII control characters between its first and last
    word; a keyword query may.
    """
    if not text.strip():
        raise ValueError("query is empty")
    if to_embed and any(c < " " or c == "\x7f" for c in text.strip()):
        raise ValueError("query holds control characters")
    if len(text.encode("utf-8")) > MAX_QUERY_BYTES:
        raise ValueError(f"query is longer than {MAX_QUERY_BYTES} bytes")
    check_page(max_results)


def query_fault(text: Column, to_embed: bool = True) -> Column:
    """Why ``check_query`` rejects a text (``empty``, ``control``, ``too long``), or null."""
    inner = trimmed(text)
    control = F.lit(to_embed) & inner.rlike(r"[\x00-\x1F\x7F]")
    return F.when(text.isNull() | (inner == ""), "empty").when(control, "control").when(F.octet_length(text) > MAX_QUERY_BYTES, "too long")


def sound_queries(queries: DataFrame, to_embed: bool = True) -> DataFrame:
    """The queries that a retriever answers; ``query_fault`` tells about the others."""
    return queries.where(query_fault(F.col("text"), to_embed).isNull())


def ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Adds ``rank`` in the total order of results and cuts at ``most``."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("created_at").desc(), "id")
    rows = rows.withColumn("rank", F.row_number().over(w))
    return rows if most is None else rows.where(F.col("rank") <= most)


def explained(rows: DataFrame) -> DataFrame:
    """Adds ``explanation``: rank among the results of the query."""
    total = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return rows.withColumn("explanation", F.concat(F.lit("rank "), F.col("rank").cast("string"), F.lit("/"), total.cast("string")))


def semantic(queries: DataFrame, vectors: DataFrame, memories: DataFrame, now: Column, max_results: int, threshold: float | None = None, include_archived: bool = False) -> DataFrame:
    """Scope before the cut to ``max_results``, lifecycle and threshold (on cosine) after it."""
    return semantic_of(knn(queries, vectors, max_results), memories, now, max_results, threshold, include_archived)


def semantic_of(near: DataFrame, memories: DataFrame, now: Column, max_results: int, threshold: float | None = None, include_archived: bool = False) -> DataFrame:
    """``semantic`` from the ranked hits of a vector search, of which the first ``max_results`` count."""
    hits = near.where(F.col("rank") <= max_results).drop("rank")
    alive = F.lit(True) if include_archived else semantic_active(now)
    facts = memories.select("id", "created_at", alive.alias("alive"))
    rows = hits.join(facts, "id").where("alive").drop("alive")
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    return ranked(rows, max_results)


def keyword(queries: DataFrame, index: bm25.KeywordIndex, memories: DataFrame, now: Column, max_results: int) -> DataFrame:
    """Scope and lifecycle both after the cut; BM25 statistics span all scopes. No threshold."""
    hits = bm25.search(queries, index, max_results).drop("rank")
    facts = memories.select("id", "created_at", "boundary", keyword_active(now).alias("alive"))
    rows = hits.join(facts, "id").join(queries.select("query_id", "scopes"), "query_id").where(F.array_contains("scopes", F.col("boundary")) & F.col("alive"))
    return ranked(rows.select("query_id", "id", "score", "created_at"), max_results)


def fuse(first: DataFrame, second: DataFrame, max_results: int) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists."""
    a = first.select("query_id", "id", F.col("rank").alias("rank_a"), F.col("created_at").alias("created_a"))
    b = second.select("query_id", "id", F.col("rank").alias("rank_b"), F.col("created_at").alias("created_b"))
    both = a.join(b, ["query_id", "id"], "full")
    return ranked(both.select("query_id", "id", rrf(F.col("rank_a"), F.col("rank_b")).alias("score"), F.coalesce("created_a", "created_b").alias("created_at")), max_results)


def hybrid(queries, vectors, index, memories, now: Column, max_results: int, threshold: float | None = None, top_each: int = TOP_EACH) -> DataFrame:
    """Fusion of the semantic and the keyword list; the threshold concerns the semantic one alone."""
    each = min(max(top_each, 1), MAX_RESULTS)
    return fuse(semantic(queries, vectors, memories, now, each, threshold), keyword(queries, index, memories, now, each), max_results)


def abstaining(results: DataFrame, queries: DataFrame, index: bm25.KeywordIndex, least: float = ABSTAIN_BELOW) -> DataFrame:
    """``results`` of the queries whose best keyword score reaches ``least``; nothing for the others."""
    best = bm25.search(queries, index, 1).where(F.col("score") >= least).select("query_id")
    return results.join(best, "query_id", "left_semi")


def union_distinct(*channels: DataFrame) -> DataFrame:
    """``query_id, id, score, position``: the channels' hits one channel after the other, the first place of each fact."""
    whole = None
    for n, channel in enumerate(channels):
        part = channel.select("query_id", "id", F.lit(n).alias("channel"), "rank", F.col("score").cast("double").alias("score"))
        whole = part if whole is None else whole.unionByName(part)
    first = whole.groupBy("query_id", "id").agg(F.min(F.struct("channel", "rank", "score")).alias("place"))
    w = Window.partitionBy("query_id").orderBy("place.channel", "place.rank", "id")
    return first.select("query_id", "id", F.col("place.score").alias("score"), F.row_number().over(w).alias("position"))


def pool(base: DataFrame, semantic_hits: DataFrame, graph_hits: DataFrame) -> DataFrame:
    """The candidates of a search: graph, semantic and base hits in that order, whole."""
    return union_distinct(graph_hits, semantic_hits, base)


def read_pool(base: DataFrame, semantic_hits: DataFrame) -> DataFrame:
    """The candidates of a read: base hits, then the semantic hits that are missing there."""
    return union_distinct(base, semantic_hits)


def scored_part(pooled: DataFrame, most: int = POOL) -> DataFrame:
    """The candidates that a relevance scorer is asked about."""
    return pooled.where(F.col("position") <= most)


def reranked(pooled: DataFrame, logits: DataFrame | None, max_results: int, threshold: float | None = None, most: int = POOL) -> DataFrame:
    """The first ``most`` candidates by sigmoid of the scorer's logit (``query_id, id, logit``), ties in pool order.

    The threshold applies after the sigmoid. A missing logit scores 0. Without a scorer
    (``logits`` is None) the whole pool comes back in its order and with its own scores.
    """
    if logits is None:
        rows, order = pooled, [F.col("position")]
    else:
        scored = scored_part(pooled, most).drop("score").join(logits, ["query_id", "id"], "left")
        rows = scored.withColumn("score", F.coalesce(sigmoid(F.col("logit").cast("double")), F.lit(0.0)))
        order = [F.col("score").desc(), F.col("position")]
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    w = Window.partitionBy("query_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_results).select("query_id", "id", "score", "position", "rank")


def search_hint(results: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, hint``: ``strong`` if the top score is high or well apart from the second, else ``weak``."""
    tops = results.where(F.col("rank") <= 2).groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    strong = (F.col("top") >= STRONG) | ((F.col("top") > 0) & F.col("second").isNotNull() & (F.col("top") >= SEPARATION * F.col("second"))) | ((F.col("top") > 0) & F.col("second").isNull())
    return queries.select("query_id").join(tops, "query_id", "left").select("query_id", F.when(F.coalesce(strong, F.lit(False)), "strong").otherwise("weak").alias("hint"))


def relevance_gate(results: DataFrame, semantic_hits: DataFrame, floor: float = COSINE_FLOOR) -> DataFrame:
    """``results`` of the queries whose best cosine reaches ``floor``."""
    open_ = semantic_hits.where((F.col("rank") == 1) & (F.col("score") >= floor)).select("query_id")
    return results.join(open_, "query_id", "left_semi")


def structured_read(results: DataFrame, queries: DataFrame, topics: DataFrame, scorer: bool = True) -> DataFrame:
    """``query_id, abstain, top_relevance, id, rank, topic``: every fact found, with its report topic.

    ``topics`` has ``id, topic, generated_at``; of several the last report's wins. ``abstain``
    is a hint and removes no fact: the query has no result or, where a ``scorer`` ranked
    them, a weak hint or a best score below the signal floor. A query without a result has
    one row without a fact.
    """
    w = Window.partitionBy("id").orderBy(F.col("generated_at").desc(), F.col("topic").desc())
    label = topics.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") == 1).select("id", "topic")
    top = results.where(F.col("rank") == 1).select("query_id", F.col("score").alias("top"))
    judged = search_hint(results, queries).join(top, "query_id", "left")
    weak = F.col("top").isNull() | ((F.col("hint") == "weak") | (F.col("top") < NO_SIGNAL) if scorer else F.lit(False))
    judged = judged.select("query_id", weak.alias("abstain"), F.coalesce("top", F.lit(0.0)).alias("top_relevance"))
    facts = results.join(label, "id", "left").select("query_id", "id", "rank", "topic")
    return judged.join(facts, "query_id", "left").select("query_id", "abstain", "top_relevance", "id", "rank", "topic")


#: Newest layout of a report that is understood.
REPORT_VERSION = 1
#: Staleness level to warning code and severity.
STALE_CODES = {"info": ("report_stale_info", "info"), "warning": ("report_stale_warn", "warn"), "critical": ("report_stale_critical", "critical")}


def report_warnings(scopes: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """``query_id, position, turn, boundary, code, severity``: what is wrong with the reports of each caller's scopes.

    ``scopes``: ``query_id, scopes`` (array in the caller's order). ``reports``: ``boundary,
    schema_version, generated_at, topic_names_unavailable``. A missing report and one of a
    newer layout are both ``report_missing``; a time to come hides the age. Order by
    ``query_id, position, turn``.
    """
    asked = scopes.select("query_id", F.posexplode(F.array_distinct("scopes")).alias("position", "boundary"))
    last = reports.groupBy("boundary").agg(F.max_by(F.struct("schema_version", "generated_at", "topic_names_unavailable"), "generated_at").alias("r"))
    both = asked.join(last, "boundary", "left")
    known = F.col("r").isNotNull() & (F.col("r.schema_version") <= REPORT_VERSION)
    known = F.coalesce(known, F.lit(False))
    ahead = F.col("r.generated_at") > now
    level = staleness(F.col("r.generated_at"), now)
    told = lambda turn, code, severity: F.struct(F.lit(turn).alias("turn"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    found = [F.when(~known, told(0, "report_missing", "warn")), F.when(known & ahead, told(1, "clock_skew_detected", "critical"))]
    found += [F.when(known & ~ahead & (level == name), told(2, *said)) for name, said in STALE_CODES.items()]
    found.append(F.when(known & F.col("r.topic_names_unavailable"), told(3, "topic_names_unavailable", "info")))
    each = both.select("query_id", "position", "boundary", F.explode(F.array_compact(F.array(*found))).alias("w"))
    return each.select("query_id", "position", "w.turn", "boundary", "w.code", "w.severity")


def read_status(queries: DataFrame, warnings: DataFrame) -> DataFrame:
    """``query_id, status, warnings``: ``ok`` without a warning, ``critical`` with a critical one, else ``degraded``."""
    told = warnings.groupBy("query_id").agg(F.max((F.col("severity") == "critical").cast("int")).alias("worst"), F.count(F.lit(1)).alias("warnings"))
    status = F.when(F.col("worst") == 1, "critical").when(F.col("warnings") > 0, "degraded").otherwise("ok")
    return queries.select("query_id").join(told, "query_id", "left").select("query_id", status.alias("status"), F.coalesce("warnings", F.lit(0).cast("bigint")).alias("warnings"))


def report_health(reports: DataFrame, now: Column) -> DataFrame:
    """Per scope the staleness of its report, and the roll-up over all: critical beats any warning."""
    levels = reports.select("boundary", staleness(F.col("generated_at"), now).alias("level"))
    overall = F.when(F.max((F.col("level") == "critical").cast("int")) == 1, "critical").when(F.max((F.col("level") != "ok").cast("int")) == 1, "degraded").otherwise("ok")
    return levels.groupBy().agg(overall.alias("overall"), F.count_if(F.col("level") != "ok").alias("warnings"))
