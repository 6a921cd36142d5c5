"""Scans and bounded walks over entities and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import is_hub, words
from engram.operators.scope import graph_current, in_scope
from engram.sources.tables import ALIAS_RELATIONS

MAX_HOPS = 2
MAX_ENTITIES = 8
MAX_CANDIDATES = 32
GRAPH_SCORE = 0.5


def list_entities(entities: DataFrame, boundaries: list[str]) -> DataFrame:
    return entities.where(in_scope(boundaries)).orderBy("id")


def entity_by_key(entities: DataFrame, name: str, entity_type: str, boundary: str) -> DataFrame:
    """Exact, case-sensitive natural key."""
    return entities.where((F.col("name") == name) & (F.col("entity_type") == entity_type) & (F.col("boundary") == boundary))


def _scoped(nodes: DataFrame, boundaries: list[str] | None) -> tuple[Column, list[str]]:
    """The scope filter of an edge's ``boundary``, and the column of ``nodes`` it needs: one list for all or ``scopes`` of each."""
    return (in_scope(boundaries), []) if boundaries is not None else (F.array_contains("scopes", F.col("boundary")), ["scopes"])


def neighbourhood(relationships: DataFrame, nodes: DataFrame, boundaries: list[str] | None = None) -> DataFrame:
    """Open edges of each node in both directions: two equi-joins instead of one join on OR.

    Without ``boundaries`` each row of ``nodes`` (``id, scopes``) sees the edges in its own ``scopes``.
    """
    inside, own = _scoped(nodes, boundaries)
    open_ = relationships.where(F.col("valid_until").isNull())
    starts = nodes.select(F.col("id").alias("node"), *own).distinct()
    out = starts.join(open_, F.col("node") == F.col("from_entity_id")).where(inside)
    back = starts.join(open_, F.col("node") == F.col("to_entity_id")).where(inside)
    return out.unionByName(back).dropDuplicates(["node", *own, "id"])


def traverse(
    relationships: DataFrame,
    entities: DataFrame,
    starts: DataFrame,
    boundaries: list[str] | None = None,
    max_hops: int = MAX_HOPS,
    relations: list[str] | None = None,
    follow_aliases: bool = False,
) -> DataFrame:
    """``start, entity_id, depth, path, name, entity_type, boundary``: entities reached along open outgoing edges.

    Paths visit no entity twice; the shortest path of each entity is kept, ties by the
    edge ids on the path. Every edge walked and the entity reached must be in scope; the
    start and entities in between are not looked at. Without ``boundaries`` each row of
    ``starts`` (``id, scopes``) walks within its own ``scopes``, which come back with it.
    """
    inside, own = _scoped(starts, boundaries)
    steps = relationships.where(F.col("valid_until").isNull())
    if relations is not None:
        steps = steps.where(F.col("relation_type").isin(*relations))
    if not follow_aliases:
        steps = steps.where(~F.col("relation_type").isin(*ALIAS_RELATIONS))
    steps = steps.select(F.col("from_entity_id").alias("_at"), F.col("to_entity_id").alias("_to"), F.col("id").alias("_edge"), "boundary")
    walk = starts.select(F.col("id").alias("start"), *own).distinct()
    walk = walk.select("start", *own, F.col("start").alias("_at"), F.array("start").alias("seen"), F.array().cast("array<string>").alias("path"))
    found = None
    for depth in range(1, max_hops + 1):
        walk = walk.join(steps, "_at").where(inside & ~F.array_contains("seen", F.col("_to")))
        walk = walk.select("start", *own, F.col("_to").alias("_at"), F.array_append("seen", F.col("_to")).alias("seen"), F.array_append("path", F.col("_edge")).alias("path"))
        here = walk.select("start", *own, F.col("_at").alias("entity_id"), F.lit(depth).alias("depth"), "path")
        found = here if found is None else found.unionByName(here)
    kept = entities.select(F.col("id").alias("entity_id"), "name", "entity_type", "boundary")
    w = Window.partitionBy("start", *own, "entity_id").orderBy("depth", "path")
    return found.join(kept, "entity_id").where(inside).withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") == 1).drop("_turn")


def path_edges(paths: DataFrame, relationships: DataFrame) -> DataFrame:
    """The edges of each path of ``traverse`` as rows, with ``position`` along the path from 0."""
    steps = paths.select("start", "entity_id", "depth", F.posexplode("path").alias("position", "edge"))
    return steps.join(relationships.withColumnRenamed("id", "edge"), "edge")


def _runs(said: Column, lengths: list[int]) -> Column:
    """All runs of consecutive words of the given lengths, each once."""
    run = lambda n: F.when(F.size(said) >= n, F.transform(F.sequence(F.lit(0), F.size(said) - n), lambda i: F.array_join(F.slice(said, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[run(n) for n in lengths]))


def mentioned_entities(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """``query_id, id``: up to ``MAX_ENTITIES`` entities (by id) in scope that each query names.

    An equi-join on whole names: a query's text is read as its runs of words of every length
    that a name has (the lengths are read first; a name of 256 bytes has at most 128 words).
    So names that begin alike do not meet, and a query makes rows by its own length only. Of
    entities with one name and scope the first ``MAX_ENTITIES`` by id can be in a result; the
    others are left out before the join, so a name that very many bear costs no more.
    """
    named = entities.where(~is_hub(F.col("name"))).select("id", "boundary", words(F.col("name")).alias("named")).where(F.size("named") > 0)
    lengths = sorted(r.n for r in named.select(F.size("named").alias("n")).distinct().collect())
    asked = queries.select("query_id", "scopes", words(F.col("text")).alias("asked"))
    if not lengths:
        return asked.limit(0).select("query_id", F.lit("").alias("id"), "scopes", F.lit(0).alias("entity_turn"))
    w = Window.partitionBy("said", "boundary").orderBy("id")
    first = named.select("id", "boundary", F.array_join("named", " ").alias("said")).withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= MAX_ENTITIES).drop("_turn")
    runs = asked.select("query_id", "scopes", F.explode(_runs(F.col("asked"), lengths)).alias("said"))
    hits = runs.join(first, "said").where(F.array_contains("scopes", F.col("boundary"))).select("query_id", "id", "scopes")
    w = Window.partitionBy("query_id").orderBy("id")
    return hits.withColumn("entity_turn", F.row_number().over(w)).where(F.col("entity_turn") <= MAX_ENTITIES)


def _first_links(links: DataFrame) -> DataFrame:
    """Of each entity (``start, scopes``) the first link to each of its first ``MAX_CANDIDATES`` facts.

    Whatever a query reads before, reading ends at the latest where one entity has connected that
    many facts, so later links can be in no result: a hub costs its edges once and
    ``MAX_CANDIDATES`` rows for every query that names it. Links of one place stay together.
    """
    firsts = links.groupBy("start", "scopes", "id").agg(F.min("place").alias("place"))
    w = Window.partitionBy("start", "scopes").orderBy("place")
    return firsts.withColumn("_turn", F.rank().over(w)).where(F.col("_turn") <= MAX_CANDIDATES).drop("_turn")


def retrieve_graph(queries: DataFrame, memories: DataFrame, entities: DataFrame, relationships: DataFrame, max_results: int | None = None) -> DataFrame:
    """``query_id, id, score, created_at, rank, explanation``: current facts on edges around the mentioned entities.

    Entities are read by id; of each its own edges by id come first, then the edges along
    its paths, shorter paths first. Reading stops at the edge that connects fact number
    ``MAX_CANDIDATES``. Edges, entities reached and facts must be in the query's scopes. All
    hits score ``GRAPH_SCORE``; they are ranked newest first, then by id descending, and cut
    at ``max_results``.
    """
    named = mentioned_entities(queries, entities).withColumn("scopes", F.array_sort(F.array_distinct("scopes")))
    starts = named.select("id", "scopes").distinct()
    near = neighbourhood(relationships, starts).select(F.col("node").alias("start"), "scopes", F.col("source_memory_id").alias("id"), F.struct(F.lit(0).alias("depth"), F.array("id").alias("path"), F.lit(0).alias("position")).alias("place"))
    walked = traverse(relationships, entities, starts).select("start", "scopes", "depth", "path", F.posexplode("path").alias("position", "edge"))
    source = relationships.select(F.col("id").alias("edge"), F.col("source_memory_id").alias("id"))
    far = walked.join(source, "edge").select("start", "scopes", "id", F.struct("depth", "path", "position").alias("place"))
    links = _first_links(near.unionByName(far).where(F.col("id").isNotNull()))
    name = entities.select(F.col("id").alias("start"), "name")
    read = named.select("query_id", "entity_turn", "scopes", F.col("id").alias("start")).join(links, ["start", "scopes"]).join(name, "start")
    # The first time each entity connects each fact, in reading order.
    met = read.groupBy("query_id", "scopes", "id", "entity_turn", "name").agg(F.min("place").alias("place")).withColumn("met", F.struct("entity_turn", "place"))
    first = met.groupBy("query_id", "id").agg(F.min("met").alias("first"))
    turn = Window.partitionBy("query_id").orderBy("first", "id")
    chosen = first.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= MAX_CANDIDATES)
    last = Window.partitionBy("query_id")
    chosen = chosen.withColumn("until", F.when(F.max("_turn").over(last) == MAX_CANDIDATES, F.max("first").over(last))).select("query_id", "id", "until")
    told = met.join(chosen, ["query_id", "id"]).where(F.col("until").isNull() | (F.col("met") <= F.col("until")))
    via = told.groupBy("query_id", "scopes", "id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    facts = memories.where(graph_current()).select("id", "created_at", "boundary")
    joined = via.join(facts, "id").where(F.array_contains("scopes", F.col("boundary")))
    newest = Window.partitionBy("query_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    ranked = joined.withColumn("rank", F.row_number().over(newest))
    ranked = ranked if max_results is None else ranked.where(F.col("rank") <= max_results)
    return ranked.select("query_id", "id", F.lit(GRAPH_SCORE).alias("score"), "created_at", "rank", F.concat(F.lit("graph: connected via "), "names").alias("explanation"))
