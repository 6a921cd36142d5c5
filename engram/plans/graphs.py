"""Entities, relationships and walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import enrich, evaluate, graph, retrieval
from engram.plans import search
from engram.plans import sql as S
from engram.plans.register import Register
from engram.sources import tables, views
from engram.sources.shared import table
from engram.sources.views import DAY, EPOCH, NOW

REGISTER = Register()
SCOPE = ["asia", "europe", "africa"]
_IN = "('asia', 'europe', 'africa')"
_G = f"{S.ENTITIES}, {S.EDGES}"
seconds = F.unix_seconds


@REGISTER(f"WITH {S.ENTITIES} SELECT id, name, entity_type, boundary FROM entities WHERE boundary IN {_IN}")
def entities_in_scope(spark, d):
    return graph.list_entities(views.entities(spark, d), SCOPE).select("id", "name", "entity_type", "boundary")


@REGISTER(f"WITH {S.ENTITIES}, wanted AS (SELECT name FROM entities WHERE entity_type = 'location' AND boundary = 'europe' ORDER BY id LIMIT 1) SELECT id, name, boundary FROM entities WHERE name = (SELECT name FROM wanted) AND entity_type = 'location' AND boundary = 'europe'")
def entity_lookup(spark, d):
    e = views.entities(spark, d)
    name = e.where("entity_type = 'location' and boundary = 'europe'").orderBy("id").first().name
    return graph.entity_by_key(e, name, "location", "europe").select("id", "name", "boundary")


def _starts(spark, d):
    return views.entities(spark, d).where("entity_type in ('location', 'organization')").select("id")


@REGISTER(f"WITH {_G}, o AS (SELECT * FROM edges WHERE ends IS NULL AND boundary IN {_IN}), s AS (SELECT id AS node FROM entities WHERE entity_type IN ('location', 'organization')) SELECT node, id AS edge FROM s JOIN o ON f = node UNION SELECT node, id FROM s JOIN o ON t = node")
def neighbourhoods(spark, d):
    return graph.neighbourhood(views.relationships(spark, d), _starts(spark, d), SCOPE).select("node", F.col("id").alias("edge"))


@REGISTER(
    f"""WITH RECURSIVE {_G}, o AS (SELECT * FROM edges WHERE ends IS NULL AND boundary IN {_IN}),
walk AS (SELECT id AS start, id AS pos, [id] AS seen, CAST([] AS VARCHAR[]) AS path, 0 AS depth FROM entities WHERE entity_type <> 'location'
  UNION ALL SELECT start, t, list_append(seen, t), list_append(path, o.id), depth + 1 FROM walk JOIN o ON f = pos WHERE depth < 2 AND NOT list_contains(seen, t)),
best AS (SELECT *, row_number() OVER (PARTITION BY start, pos ORDER BY depth, path) AS turn FROM walk WHERE depth > 0)
SELECT start, pos AS entity_id, CAST(depth AS INTEGER) AS depth, array_to_string(path, ',') AS path, name FROM best JOIN entities e ON e.id = pos WHERE turn = 1 AND e.boundary IN {_IN}"""
)
def bounded_walks(spark, d):
    starts = views.entities(spark, d).where("entity_type <> 'location'").select("id")
    made = graph.traverse(views.relationships(spark, d), views.entities(spark, d), starts, SCOPE)
    return made.select("start", "entity_id", "depth", F.array_join("path", ",").alias("path"), "name")


SCOPES = (SCOPE, ["america", "asia"])
_SCOPES = "CASE WHEN c_custkey % 40 = 0 THEN ['asia', 'europe', 'africa'] ELSE ['america', 'asia'] END"


def _queries(spark, d):
    """Questions that name a customer, a nation and a hub, from callers with one of two scopes."""
    c = table(spark, d, "customer").where("c_custkey % 20 = 0").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("Where does "), "c_name", F.lit(" live, is it "), "n_name", F.lit("?"))
    first, second = (F.array(*[F.lit(b) for b in s]) for s in SCOPES)
    return c.select(F.col("c_custkey").alias("query_id"), text.alias("text"), F.when(F.col("c_custkey") % 40 == 0, first).otherwise(second).alias("scopes"))


_NAMED = f"""{_G}, q AS (SELECT c_custkey AS query_id, {S.words("'Where does ' || c_name || ' live, is it ' || n_name || '?'")} AS w, {_SCOPES} AS scopes FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 20 = 0),
e AS (SELECT id, boundary, {S.words('name')} AS w FROM entities),
named AS (SELECT * FROM (SELECT query_id, id, scopes, row_number() OVER (PARTITION BY query_id ORDER BY id) AS turn FROM q JOIN e ON list_contains(scopes, boundary) AND contains(' ' || array_to_string(q.w, ' ') || ' ', ' ' || array_to_string(e.w, ' ') || ' ')) WHERE turn <= 8)"""


@REGISTER(f"WITH {_NAMED} SELECT query_id, id, CAST(turn AS INTEGER) AS turn FROM named")
def mentioned_entities(spark, d):
    return graph.mentioned_entities(_queries(spark, d), views.entities(spark, d)).select("query_id", "id", F.col("entity_turn").alias("turn"))


def _crossed(spark, d):
    """The edges, of which some customers' lie in another scope than the ends, and nations that touch two scopes."""
    r, n = views.relationships(spark, d), F.substring("from_entity_id", 2, 12).cast("bigint")
    return r.withColumn("boundary", F.when(F.col("from_entity_id").startswith("c") & (n % 3 == 1), "america").when(F.col("from_entity_id").startswith("n") & (n % 2 == 1), "africa").otherwise(F.col("boundary")))


_CROSSED = "ce AS (SELECT * REPLACE (CASE WHEN f LIKE 'c%' AND CAST(f[2:] AS BIGINT) % 3 = 1 THEN 'america' WHEN f LIKE 'n%' AND CAST(f[2:] AS BIGINT) % 2 = 1 THEN 'africa' ELSE boundary END AS boundary) FROM edges)"
MOST_GRAPH = 12


@REGISTER(
    f"""WITH RECURSIVE {_NAMED}, {_CROSSED}, o AS (SELECT * FROM ce WHERE ends IS NULL), st AS (SELECT DISTINCT id, scopes FROM named),
walk AS (SELECT id AS start, scopes, id AS pos, [id] AS seen, CAST([] AS VARCHAR[]) AS path, 0 AS depth FROM st
  UNION ALL SELECT start, scopes, t, list_append(seen, t), list_append(path, o.id), depth + 1 FROM walk JOIN o ON f = pos WHERE depth < 2 AND NOT list_contains(seen, t) AND list_contains(scopes, boundary)),
best AS (SELECT w.*, row_number() OVER (PARTITION BY start, scopes, pos ORDER BY depth, path) AS turn FROM walk w JOIN entities en ON en.id = pos WHERE depth > 0 AND list_contains(scopes, en.boundary)),
far AS (SELECT start, scopes, unnest(path) AS edge, struct_pack(d := depth, p := path, k := unnest(range(0, len(path)))) AS place FROM best WHERE turn = 1),
near AS (SELECT DISTINCT st.id AS start, scopes, o.id AS edge, struct_pack(d := 0, p := [o.id], k := CAST(0 AS BIGINT)) AS place FROM st JOIN o ON (o.f = st.id OR o.t = st.id) AND list_contains(scopes, boundary)),
read AS (SELECT n.query_id, n.scopes, source AS id, en.name, struct_pack(t := turn, q := place) AS met FROM named n JOIN (SELECT * FROM near UNION ALL SELECT * FROM far) l ON l.start = n.id AND l.scopes = n.scopes JOIN edges ed ON ed.id = edge JOIN entities en ON en.id = n.id),
firsts AS (SELECT query_id, id, min(met) AS m FROM read GROUP BY query_id, id),
turns AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m, id) AS turn FROM firsts),
lasts AS (SELECT query_id, m FROM turns WHERE turn = 32),
via AS (SELECT r.query_id, r.scopes, r.id, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM read r JOIN turns t ON t.query_id = r.query_id AND t.id = r.id LEFT JOIN lasts z ON z.query_id = r.query_id WHERE t.turn <= 32 AND (z.m IS NULL OR r.met <= z.m) GROUP BY r.query_id, r.scopes, r.id), {S.MEMORIES.replace('lang AS boundary', "CASE WHEN doc_id % 5 = 0 THEN 'europe' ELSE 'asia' END AS boundary")},
hit AS (SELECT query_id, id, names, row_number() OVER (PARTITION BY query_id ORDER BY created DESC, id DESC) AS rank FROM via JOIN memories m USING (id) WHERE list_contains(scopes, m.boundary) AND {S.ACTIVE})
SELECT query_id, id, 0.5 AS score, CAST(rank AS INTEGER) AS rank, 'graph: connected via ' || names AS explanation FROM hit WHERE rank <= {MOST_GRAPH}"""
)
def retrieve_graph(spark, d):
    m = views.memories(spark, d).withColumn("boundary", F.when(F.col("id").cast("bigint") % 5 == 0, "europe").otherwise("asia"))
    made = graph.retrieve_graph(_queries(spark, d), m, views.entities(spark, d), _crossed(spark, d), MOST_GRAPH)
    return made.select("query_id", "id", "score", "rank", "explanation")


@REGISTER(
    f"""WITH RECURSIVE {_G}, o AS (SELECT * FROM edges WHERE ends IS NULL AND boundary IN {_IN}),
walk AS (SELECT id AS start, id AS pos, [id] AS seen, CAST([] AS VARCHAR[]) AS path, 0 AS depth FROM entities WHERE entity_type = 'organization'
  UNION ALL SELECT start, t, list_append(seen, t), list_append(path, o.id), depth + 1 FROM walk JOIN o ON f = pos WHERE depth < 2 AND NOT list_contains(seen, t)),
best AS (SELECT *, row_number() OVER (PARTITION BY start, pos ORDER BY depth, path) AS turn FROM walk WHERE depth > 0)
SELECT start, entity_id, CAST(position AS INTEGER) AS position, edge, relation_type FROM (SELECT start, pos AS entity_id, unnest(path) AS edge, unnest(range(0, len(path))) AS position FROM best JOIN entities e ON e.id = pos WHERE turn = 1 AND e.boundary IN {_IN}) JOIN edges x ON x.id = edge"""
)
def walked_edges(spark, d):
    """The edges along each path, in their order."""
    r, e = views.relationships(spark, d), views.entities(spark, d)
    paths = graph.traverse(r, e, e.where("entity_type = 'organization'").select("id"), SCOPE)
    return graph.path_edges(paths, r).select("start", "entity_id", "position", "edge", "relation_type")


@REGISTER(f"WITH {S.ENTITIES} SELECT id, entity_type FROM entities WHERE entity_type = 'person' AND CAST(id[2:] AS BIGINT) % 2 = 1")
def new_entities(spark, d):
    """Customers offered again: every second is known already, and each is offered twice."""
    e = views.entities(spark, d)
    person = e.where("entity_type = 'person'")
    known = e.where(~((F.col("entity_type") == "person") & (F.substring("id", 2, 12).cast("bigint") % 2 == 1)))
    added, _ = tables.new_entities(known, person.unionByName(person.withColumn("id", F.concat("id", F.lit("x")))))
    return added.select("id", "entity_type")


@REGISTER(f"WITH {_G} SELECT 'missing endpoint' AS verdict, (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'crosses boundaries', (SELECT count(*) FROM nation WHERE n_regionkey <> 0) UNION ALL SELECT 'added', (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation)")
def new_relationships(spark, d):
    """Good edges, edges from an unknown entity, and edges from every nation to the first region."""
    e, r = views.entities(spark, d), views.relationships(spark, d)
    offered = r.where("from_entity_id like 'c%'").unionByName(r.where("from_entity_id like 's%'").withColumn("from_entity_id", F.lit("nobody")))
    nations = r.where("relation_type = 'in_region'").withColumn("to_entity_id", F.lit("r000000000000")).withColumn("id", F.concat("id", F.lit("!")))
    aliases = r.where("relation_type = 'in_region'").withColumn("relation_type", F.lit("same_as")).withColumn("to_entity_id", F.lit("r000000000000"))
    added, refused = tables.new_relationships(e, offered.unionByName(nations).unionByName(aliases.where("boundary <> 'africa'")))
    return added.select(F.lit("added").alias("verdict")).union(refused.select("reason")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@REGISTER(
    f"""WITH {_G} SELECT id, CASE WHEN relation_type = 'in_nation' AND f LIKE 'c%' AND ends IS NULL THEN {EPOCH + DAY} ELSE ends END AS ends FROM edges
UNION ALL SELECT id || '+', NULL FROM edges WHERE f LIKE 'c%' AND ends IS NULL"""
)
def superseded_relationships(spark, d):
    r = views.relationships(spark, d)
    changes = r.where("from_entity_id like 'c%'").select(F.col("id").alias("old_id"), F.concat("id", F.lit("+")).alias("id"), *[F.col(c) for c in r.columns if c not in ("id", "valid_from", "valid_until")], views.at(EPOCH + DAY).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"))
    made, _ = tables.supersede_relationships(r, changes.select("old_id", *r.columns))
    return made.select("id", seconds("valid_until").alias("ends"))


@REGISTER(f"WITH {_G}, {S.MEMORIES} SELECT e.id, CASE WHEN e.ends IS NULL AND source IN (SELECT id FROM memories WHERE NOT ({S.ACTIVE})) THEN {NOW} ELSE e.ends END AS ends FROM edges e")
def reconciled_edges(spark, d):
    made = enrich.reconcile_edges(views.relationships(spark, d), views.memories(spark, d), views.now())
    return made.select("id", seconds("valid_until").alias("ends"))


@REGISTER(f"WITH {search._BASE}, {search._FUSED}, x AS (SELECT query_id, (SELECT min(rank) FROM fused f WHERE f.query_id = tq.query_id AND f.id = lpad(CAST(tq.query_id AS VARCHAR), 12, '0')) AS r FROM tq) SELECT round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM x")
def retrieval_scores(spark, d):
    q, _, rows, _ = search._hybrid(spark, d)
    expected = q.select("query_id", views.key("query_id").alias("id"))
    made = evaluate.recall_and_mrr(rows, expected, (5, 10))
    return made.select(*[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "mrr")])


@REGISTER(f"WITH {search._BASE}, {search._POOL}, {search._HINTS} SELECT CASE WHEN query_id % 2 = 0 THEN 'strong' ELSE 'weak' END AS expected, hint AS actual, count(*) AS n FROM hints GROUP BY ALL")
def hint_confusion(spark, d):
    q, _, rows = search._reranked(spark, d)
    hints = retrieval.search_hint(rows, q)
    return evaluate.confusion(hints.select(F.when(F.col("query_id") % 2 == 0, "strong").otherwise("weak").alias("expected"), F.col("hint").alias("actual")))
