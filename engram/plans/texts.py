"""Text functions over conversations, parts and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import text as X
from engram.functions.numbers import content_fingerprint
from engram.operators import enrich
from engram.plans import sql as S
from engram.plans.register import Register
from engram.sources import views
from engram.sources.shared import table

REGISTER = Register()


@REGISTER(f"SELECT conv_id, turn, CAST(len({S.words('text')}) AS INTEGER) AS words, CAST(len({S.terms('text')}) AS INTEGER) AS terms, array_to_string({S.terms('text')}[1:3], ' ') AS head FROM conversations")
def tokenizers(spark, d):
    c = table(spark, d, "conversations")
    t = X.index_terms(F.col("text"))
    return c.select("conv_id", "turn", F.size(X.words(F.col("text"))).alias("words"), F.size(t).alias("terms"), F.array_join(F.slice(t, 1, 3), " ").alias("head"))


@REGISTER(
    f"""WITH w AS (SELECT doc_id, {S.words('text')} AS w FROM documents), p AS (SELECT a.doc_id, a.w AS x, b.w AS y FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN CAST(len(list_intersect(list_distinct(x), list_distinct(y))) AS DOUBLE) / least(len(list_distinct(x)), len(list_distinct(y))) ELSE 0 END, 6) AS containment,
x <> y AND list_sort(x) = list_sort(y) AS reordering FROM p"""
)
def containment_of_neighbours(spark, d):
    w = table(spark, d, "documents").select("doc_id", X.words(F.col("text")).alias("w"))
    pair = w.select("doc_id", F.col("w").alias("x")).join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("y")), "doc_id")
    return pair.select("doc_id", F.round(X.containment(F.col("x"), F.col("y")), 6).alias("containment"), X.is_reordering(F.col("x"), F.col("y")).alias("reordering"))


_STARTS = ["When asked, I think that ", "The user told me that ", "i PREFER ", "I believe I use ", ""]


@REGISTER(
    """WITH t AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations),
s AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 1 THEN 'The user ' || t WHEN 2 THEN 'The user prefers ' || t WHEN 3 THEN 'The user uses ' || t
  ELSE CASE WHEN regexp_matches(t, '^[a-z]') THEN upper(t[1:1]) || t[2:] ELSE t END END AS s FROM t)
SELECT conv_id, turn, CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END AS saved FROM s"""
)
def canonical_save(spark, d):
    c = table(spark, d, "conversations")
    start = F.element_at(F.array(*[F.lit(s) for s in _STARTS]), (F.col("conv_id") % 5 + 1).cast("int"))
    said = c.select("conv_id", "turn", F.concat(F.lit("  "), start, F.regexp_replace("text", r"^\s+|\s+\z", ""), F.lit("\n")).alias("said"))
    return X.canonical_form(said, "said", "saved").select("conv_id", "turn", "saved")


@REGISTER(
    """SELECT p_partkey, rtrim(left(regexp_replace(regexp_replace(regexp_replace(lower(trim(' ' || p_type || ' -- ' || p_brand || '! ')), '[^a-z0-9_\\s-]', '', 'g'), '[_\\s-]+', '_', 'g'), '^_', ''), 64), '_') AS relation,
CASE p_size % 3 WHEN 0 THEN 'organization' WHEN 1 THEN 'person' ELSE 'concept' END AS label FROM part"""
)
def relation_names(spark, d):
    p = table(spark, d, "part")
    raw = F.concat(F.lit(" "), "p_type", F.lit(" -- "), "p_brand", F.lit("! "))
    label = F.when(F.col("p_size") % 3 == 0, " Organisation").when(F.col("p_size") % 3 == 1, "PERSON ").otherwise("thing")
    return p.select("p_partkey", X.relation_name(raw).alias("relation"), X.entity_label(label).alias("label"))


@REGISTER(
    """SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS snippet, length(left(text, 2000)) + 11 AS prompt_chars,
CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' END AS took
FROM (SELECT *, doc_id * 37 % 9000 AS s FROM documents)"""
)
def text_formats(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", X.snippet(F.col("text")).alias("snippet"), F.length(X.rerank_prompt(F.col("text"))).cast("bigint").alias("prompt_chars"), X.duration(F.col("doc_id") * 37 % 9000).alias("took"))


@REGISTER("SELECT c_custkey, 'x' || ' Topics: ' || lower(c_mktsegment) || ', b' AS composed FROM customer")
def enriched_text(spark, d):
    aliases = F.array(F.concat(F.lit(" "), "c_mktsegment"), F.lit("  "), F.lit("B "))
    return table(spark, d, "customer").select("c_custkey", X.embed_text(F.lit("x"), X.clean_aliases(aliases)).alias("composed"))


@REGISTER(f"WITH {S.MEMORIES} SELECT id FROM memories WHERE {S.ACTIVE} AND n % 2 = 0")
def facts_to_enrich(spark, d):
    m = views.memories(spark, d)
    done = F.col("id").cast("bigint") % 2 == 1
    stored = F.concat(F.lit('{"enrichment":{"content_fp":"'), content_fingerprint(F.col("content")), F.lit('"}}'))
    return enrich.to_enrich(m.withColumn("metadata_json", F.when(done, stored).otherwise(F.col("metadata_json")))).select("id")


def _answers(spark, d):
    """Model answers about nations: ends in other case, a repeat, a loop and an unlisted end."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    item = lambda *pairs: F.struct(*[F.lit(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in pairs])
    nation, region = F.col("n_name"), F.col("r_name")
    names = F.array(item(("name", nation), ("type", "Location")), item(("name", F.lower(nation)), ("type", "location")), item(("name", F.concat(F.lit("The "), region)), ("type", "odd")), item(("name", F.lit(" ")), ("type", "person")))
    link = lambda a, rel, b: item(("from", a), ("relation", rel), ("to", b))
    home = F.concat(F.lit("the "), F.lower(region))
    links = F.array(link(F.lower(nation), "Lies in!", home), link(nation, "lies-in", home), link(nation, "is", nation), link(nation, "knows", F.lit("nobody")))
    return both.select(F.col("n_nationkey").alias("memory_id"), F.to_json(F.struct(names.alias("entities"), links.alias("relationships"))).alias("json"))


@REGISTER("SELECT n_nationkey AS memory_id, n_name AS name, 'location' AS entity_type FROM nation UNION ALL SELECT n_nationkey, 'The ' || r_name, 'concept' FROM nation JOIN region ON n_regionkey = r_regionkey")
def extracted_entities(spark, d):
    return enrich.extracted_entities(_answers(spark, d)).select("memory_id", "name", "entity_type")


@REGISTER("SELECT n_nationkey AS memory_id, n_name AS from_name, 'lies_in' AS relation, 'The ' || r_name AS to_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def extracted_relationships(spark, d):
    return enrich.extracted_relationships(_answers(spark, d)).select("memory_id", "from_name", "relation", "to_name")
