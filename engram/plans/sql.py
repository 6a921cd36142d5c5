"""Parts of the oracle SQL (DuckDB): the views of ``engram.sources.views`` as common tables."""

from __future__ import annotations

from engram.functions.text import LONGEST_TOKEN_BYTES, STOP_WORDS
from engram.sources.views import DAY, EPOCH, NOW

KEY = "lpad(CAST({} AS VARCHAR), 12, '0')"

MEMORIES = f"""memories AS (SELECT {KEY.format('doc_id')} AS id, doc_id AS n, text AS content,
  CASE doc_id % 3 WHEN 0 THEN 'episodic' WHEN 1 THEN 'semantic' ELSE 'procedural' END AS memory_type,
  CASE WHEN doc_id % 19 = 0 THEN NULL ELSE source END AS source_agent, lang AS boundary,
  {EPOCH} + doc_id * 60 AS created, {EPOCH} + doc_id * 60 - (doc_id % 30) * {DAY} AS starts,
  CASE WHEN doc_id % 11 = 0 THEN {EPOCH} + doc_id * 60 + (doc_id % 5) * 90 * {DAY} END AS ends,
  CAST(CAST(0.5 AS DOUBLE) + CAST(doc_id % 50 AS DOUBLE) / 100 AS FLOAT) AS confidence, doc_id % 7 AS uses,
  {EPOCH} + doc_id * 60 - (doc_id % 500) * {DAY} AS used,
  CASE WHEN doc_id % 13 = 0 THEN {KEY.format('doc_id + 1')} END AS superseded_by,
  CASE WHEN doc_id % 17 = 0 THEN {EPOCH} + doc_id * 60 + 10 * {DAY} END AS archived,
  CASE WHEN doc_id % 10 = 0 AND doc_id % 70 <> 0 AND doc_id % 110 <> 0 THEN {EPOCH} + doc_id * 60 - (doc_id % 400) * {DAY} END AS decayed_at
  FROM documents)"""
VECTORS = f"""vectors AS (SELECT {KEY.format('vec_id')} AS id, vec_id AS n, CAST(embedding AS DOUBLE[]) AS e,
  CASE vec_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'es' ELSE 'fr' END AS boundary, label FROM embeddings)"""
ENTITIES = f"""scope AS (SELECT n_nationkey, replace(lower(r_name), ' ', '_') AS boundary FROM nation JOIN region ON n_regionkey = r_regionkey),
entities AS (SELECT 'c' || {KEY.format('c_custkey')} AS id, c_name AS name, 'person' AS entity_type, boundary FROM customer JOIN scope ON c_nationkey = n_nationkey
  UNION ALL SELECT 's' || {KEY.format('s_suppkey')}, s_name, 'organization', boundary FROM supplier JOIN scope ON s_nationkey = n_nationkey
  UNION ALL SELECT 'n' || {KEY.format('n_nationkey')}, n_name, 'location', boundary FROM nation JOIN scope USING (n_nationkey)
  UNION ALL SELECT 'r' || {KEY.format('r_regionkey')}, r_name, 'location', replace(lower(r_name), ' ', '_') FROM region)"""
EDGES = f"""edge0 AS (SELECT 'c' || {KEY.format('c_custkey')} AS f, 'n' || {KEY.format('n_nationkey')} AS t, 'in_nation' AS relation_type, boundary,
    CASE WHEN c_custkey % 9 = 0 THEN {EPOCH + 50 * DAY} END AS ends, {KEY.format('c_custkey')} AS source FROM customer JOIN scope ON c_nationkey = n_nationkey
  UNION ALL SELECT 's' || {KEY.format('s_suppkey')}, 'n' || {KEY.format('n_nationkey')}, 'in_nation', boundary, NULL, {KEY.format('s_suppkey')} FROM supplier JOIN scope ON s_nationkey = n_nationkey
  UNION ALL SELECT 'n' || {KEY.format('n_nationkey')}, 'r' || {KEY.format('n_regionkey')}, 'in_region', boundary, NULL, {KEY.format('n_nationkey')} FROM nation JOIN scope USING (n_nationkey)),
edges AS (SELECT f || '>' || t AS id, * FROM edge0)"""
OUTBOX = f"""outbox AS (SELECT {KEY.format('event_id')} AS id, {KEY.format('user_id')} AS memory_id, event_id AS seq, props AS payload,
  CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'write' ELSE 'update' END AS operation,
  event_id % 10 AS attempts, {EPOCH} + (event_id * 7919) % 1000000 AS due FROM events)"""

LISTED = "superseded_by IS NULL AND archived IS NULL"
ACTIVE = f"{LISTED} AND ends IS NULL"
SEMANTIC = f"{LISTED} AND coalesce(ends > {NOW}, true)"
KEYWORD = f"superseded_by IS NULL AND coalesce(ends > {NOW}, true)"

STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def terms(x: str) -> str:
    return f"list_filter({words(x)}, lambda w: strlen(w) < {LONGEST_TOKEN_BYTES} AND NOT list_contains({STOP}, w))"


POSTINGS = f"""facts AS (SELECT id, {terms('content')} AS ts FROM memories WHERE {LISTED}),
posting AS (SELECT id, len(ts) AS length, unnest(ts) AS term FROM facts),
tf AS (SELECT id, length, term, count(*) AS tf FROM posting GROUP BY id, length, term),
stat AS (SELECT count(*) AS docs, avg(len(ts)) AS average FROM facts),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
ASKED = f"""asked AS (SELECT item_id AS query_id, unnest(list_distinct({terms("translate(text, '+-!&|(){}[]^~*?:\\/\"''', repeat(' ', 20))")})) AS term FROM benchmark)"""


def bm25(k: int, name: str = "bm25") -> str:
    """Common table of the first ``k`` facts of each query, with rank."""
    return f"""{name}_all AS (SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 9) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), stat GROUP BY query_id, id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_all) WHERE rank <= {k})"""


def scopes(q: str) -> str:
    """Scopes of a query id: two for even ids, three for odd ones."""
    return f"CASE WHEN {q} % 2 = 0 THEN ['en', 'de'] ELSE ['es', 'fr', 'en'] END"


def knn(k: int, source: str, name: str = "knn") -> str:
    """Common table of the ``k`` nearest vectors in scope of ``source(query_id, e, scopes)``."""
    return f"""{name} AS (SELECT * FROM (SELECT query_id, v.id, list_cosine_similarity(q.e, v.e) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.id) AS rank
  FROM {source} q JOIN vectors v ON list_contains(q.scopes, v.boundary)) WHERE rank <= {k})"""


def ranked(rows: str, most: int) -> str:
    """Rows (query_id, id, score, created) in the total order of results."""
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created DESC, id) AS rank FROM ({rows})) WHERE rank <= {most}"


def neighbours(k: int, floor: float, name: str = "near", source: str = "vectors") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT a.boundary, a.id, b.id AS other, list_cosine_similarity(a.e, b.e) AS score,
  row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) AS turn
  FROM {source} a JOIN {source} b ON a.boundary = b.boundary AND a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= {floor}) WHERE turn <= {k})"""


def components(pairs: str, name: str = "comp") -> str:
    """Recursive common tables: ``name(id, root)`` for the nodes of ``pairs(a, b)``. Needs WITH RECURSIVE."""
    return f"""{name}_e AS (SELECT a, b FROM {pairs} UNION SELECT b, a FROM {pairs}),
{name}_r(id, r) AS (SELECT a, a FROM {name}_e UNION SELECT {name}_r.id, {name}_e.b FROM {name}_r JOIN {name}_e ON {name}_e.a = {name}_r.r),
{name} AS (SELECT id, min(r) AS root FROM {name}_r GROUP BY id)"""
