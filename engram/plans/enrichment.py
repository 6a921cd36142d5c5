"""Enrichment passes and merge decisions, from prompt to table, with models that follow a rule."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from engram.functions.clock import rfc3339
from engram.functions.jsons import metadata
from engram.functions.numbers import content_fingerprint
from engram.operators import answers, enrich
from engram.plans import sql as S
from engram.plans.register import Register
from engram.sources import views
from engram.sources.views import NOW

REGISTER = Register()
seconds = F.unix_seconds


class NamingModel:
    """Takes the first words of a fact as aliases and names; some answers are malformed, empty or missing."""

    def complete_json(self, prompts: list[str]) -> list[str | None]:
        return [self.answer(p[len(enrich.PROMPT) :]) for p in prompts]

    @staticmethod
    def answer(content: str) -> str | None:
        if (turn := len(content) % 11) < 3:
            return ("not json", '{"aliases": [" ", 5]}', None)[turn]
        first = re.findall("[A-Za-z]{3,}", content)[:3]
        kinds = ("Person", "organisation", "thing")
        named = [{"name": f" {w} ", "type": k} for w, k in zip(first, kinds)] + [{"name": w.upper(), "type": k} for w, k in zip(first, kinds)] + ["no name", {"name": 7}]
        links = [{"from": a.upper(), "relation": "Works - with!", "to": b.lower()} for a, b in zip(first, first[1:2])] * 2 + [{"from": "x y", "relation": "r", "to": w} for w in first]
        return json.dumps({"aliases": [f" {w}" for w in first] + [" ", 5], "entities": named, "relationships": links})


class CountingEmbedder:
    """Characters, spaces and letters e of a text as its vector."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" ")), float(t.count("e"))] for t in texts]


def _facts(spark, d):
    """The facts; those of odd number were enriched before."""
    own = F.concat(F.lit('{"enrichment":{"content_fp":"'), content_fingerprint(F.col("content")), F.lit('"}}'))
    return views.memories(spark, d).withColumn("metadata_json", F.when(F.col("id").cast("bigint") % 2 == 1, own).otherwise(F.col("metadata_json")))


def _first(i: int):
    return F.get(F.regexp_extract_all("content", F.lit("[A-Za-z]{3,}"), F.lit(0)), F.lit(i - 1))


def _enriched(spark, d):
    """A pass over a graph that knows the first words of every fifth fact and an edge of every third."""
    m, n = _facts(spark, d), F.col("id").cast("bigint")
    known = m.where((n % 5 == 0) & _first(1).isNotNull()).select(_first(1).alias("name"), F.lit("person").alias("entity_type"), "boundary").distinct()
    e = known.select(F.concat_ws(":", "name", "boundary").alias("id"), "*", views.at(views.EPOCH).alias("created_at"))
    old = m.where(n % 3 == 0).select(
        F.concat(F.lit("old"), "id").alias("id"), F.lit("a").alias("from_entity_id"), F.lit("b").alias("to_entity_id"), F.lit("knew").alias("relation_type"), "boundary",
        views.at(views.EPOCH).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"), F.lit(0.5).alias("confidence"), F.col("id").alias("source_memory_id"),
    )
    return m, enrich.enrich(m, views.vectors(spark, d), e, old, NamingModel, CountingEmbedder, views.now())


_W = "regexp_extract_all(content, '[A-Za-z]{3,}')"
_ENRICHED = f"""{S.MEMORIES}, due AS (SELECT *, {_W}[1:3] AS w FROM memories WHERE {S.ACTIVE} AND n % 2 = 0),
good AS (SELECT *, array_to_string(list_transform(w, lambda x: lower(x)), ', ') AS aliases FROM due WHERE length(content) % 11 >= 3 AND len(w) > 0),
texts AS (SELECT *, content || ' Topics: ' || aliases AS told FROM good),
kinds AS (SELECT id, boundary, confidence, unnest(range(1, len(w) + 1)) AS p, w FROM good),
named AS (SELECT id, boundary, confidence, p, w[p] AS name, ['person', 'organization', 'concept'][p] AS kind FROM kinds),
known AS (SELECT DISTINCT {_W}[1] AS name, 'person' AS kind, boundary FROM memories WHERE n % 5 = 0 AND len({_W}) > 0),
last AS (SELECT id, lower(name) AS k, arg_max(name, p) AS name, arg_max(kind, p) AS kind FROM named GROUP BY id, lower(name)),
link AS (SELECT g.id AS source, a.name AS from_name, a.kind AS from_kind, b.name AS to_name, b.kind AS to_kind, round(CAST(g.confidence AS DOUBLE), 4) AS confidence
  FROM good g JOIN last a ON a.id = g.id AND a.k = lower(w[1]) JOIN last b ON b.id = g.id AND b.k = lower(w[2]) WHERE a.name <> b.name),
old AS (SELECT id AS source, id IN (SELECT id FROM good) OR NOT ({S.ACTIVE}) AS ended FROM memories WHERE n % 3 = 0)"""


@REGISTER(
    f"""WITH {_ENRICHED} SELECT m.id, t.aliases, t.id IS NOT NULL OR m.n % 2 = 1 AS current, length(coalesce(told, m.content)) AS embed_chars,
CASE WHEN m.n % 2 = 0 THEN m.decayed_at END AS decayed_at FROM memories m LEFT JOIN texts t ON t.id = m.id"""
)
def enrichment_facts(spark, d):
    """Every fact after the pass: its aliases, whether they belong to its content, and the length of its stored embed text."""
    after = enrich.stored_embed_text(_enriched(spark, d)[1].commit.memories)
    m = F.col("metadata_json")
    return after.select(
        "id", metadata(m, "enrichment.aliases").alias("aliases"), F.coalesce(metadata(m, "enrichment.content_fp") == content_fingerprint(F.col("content")), F.lit(False)).alias("current"),
        F.length("embed_text").cast("bigint").alias("embed_chars"), seconds(rfc3339(metadata(m, "decay.last_decay_at"))).alias("decayed_at"),
    )


@REGISTER(
    f"""WITH {_ENRICHED}, {S.VECTORS} SELECT id, 3 AS numbers, CAST(length(told) AS DOUBLE) AS first, CAST(length(told) - length(replace(told, 'e', '')) AS DOUBLE) AS third, boundary FROM texts
UNION ALL SELECT id, len(e), round(e[1], 5), round(e[3], 5), boundary FROM vectors WHERE id NOT IN (SELECT id FROM good)"""
)
def enrichment_vectors(spark, d):
    """The vectors after the pass: those of enriched facts are new."""
    v = _enriched(spark, d)[1].vectors
    number = lambda i: F.round(F.element_at("embedding", i).cast("double"), 5)
    return v.select("id", F.size("embedding").alias("numbers"), number(1).alias("first"), number(3).alias("third"), "boundary")


@REGISTER(
    f"""WITH {_ENRICHED} SELECT source, from_name, from_kind, 'works_with' AS relation_type, to_name, to_kind, confidence, CAST(NULL AS BIGINT) AS ends FROM link
UNION ALL SELECT source, NULL, NULL, 'knew', NULL, NULL, 0.5, CASE WHEN ended THEN {NOW} END FROM old"""
)
def enrichment_edges(spark, d):
    """The edges after the pass with the entities that they join."""
    made = _enriched(spark, d)[1]
    end = lambda s: made.entities.select(F.col("id").alias(f"{s}_entity_id"), F.col("name").alias(f"{s}_name"), F.col("entity_type").alias(f"{s}_kind"))
    edges = made.relationships.join(end("from"), "from_entity_id", "left").join(end("to"), "to_entity_id", "left")
    return edges.select(F.col("source_memory_id").alias("source"), "from_name", "from_kind", "relation_type", "to_name", "to_kind", F.round("confidence", 4).alias("confidence"), seconds("valid_until").alias("ends"))


@REGISTER(f"WITH {_ENRICHED} SELECT DISTINCT name, kind, boundary FROM named UNION SELECT * FROM known")
def enrichment_entities(spark, d):
    return _enriched(spark, d)[1].entities.select("name", F.col("entity_type").alias("kind"), "boundary")


@REGISTER(
    f"""WITH {_ENRICHED}, fresh AS (SELECT DISTINCT name, kind, boundary FROM named EXCEPT SELECT * FROM known)
SELECT (SELECT count(*) FROM good) AS enriched, (SELECT count(*) FROM memories WHERE {S.ACTIVE}) - (SELECT count(*) FROM due) AS skipped, (SELECT count(*) FROM due) - (SELECT count(*) FROM good) AS failed,
(SELECT count(*) FROM fresh) AS entities_created, (SELECT count(*) FROM named) - (SELECT count(*) FROM fresh) AS entities_reused, (SELECT count(*) FROM link) AS relationships_created, (SELECT count(*) FROM old WHERE ended) AS relationships_retired"""
)
def enrichment_report(spark, d):
    return _enriched(spark, d)[1].counts


class MergingModel:
    """Reads a cluster's prompt and answers by its first id: every decision, and every way to break the form."""

    def complete_json(self, prompts: list[str]) -> list[str | None]:
        return [self.answer([m["id"] for m in json.loads(p)["memories"]], p) for p in prompts]

    @staticmethod
    def answer(ids: list[str], prompt: str) -> str | None:
        why = {"reasoning": "so", "unasked": [1]}
        told = {
            0: {"decision": "merge", "merged_text": f"{len(ids)} in one", **why},
            1: {"decision": "keep_separate", "merged_text": "not read", **why},
            2: {"decision": "contradiction", "clear_winner": ids[-1], **why},
            3: {"decision": "contradiction", "clear_winner": None, **why},
            4: {"decision": "merge", **why},
            5: {"decision": "keep_separate", "reasoning": 7},
            6: {"decision": "Merge", **why},
            7: {"decision": "contradiction", "clear_winner": 7, **why},
            8: [why],
        }
        turn = int(ids[0]) // 3 % 12
        return json.dumps(told[turn]) if turn in told else {9: '{"decision": "keep_separate", "reasoning": "cut', 10: '{"decision": "keep_separate", "reasoning": "so"} and more', 11: None}[turn]


_GROUPS = f"{S.MEMORIES}, member AS (SELECT {S.KEY.format('n // 3 * 3')} AS cluster_id, n // 3 % 12 AS turn, id, content FROM memories), groups AS (SELECT cluster_id, any_value(turn) AS turn, count(*) AS c, max(id) AS last, sum(strlen(content) + 12) AS bytes FROM member GROUP BY cluster_id)"


def _members(spark, d):
    m = views.memories(spark, d)
    return m, m.select(F.lpad((F.floor(F.col("id").cast("bigint") / 3) * 3).cast("string"), 12, "0").alias("cluster_id"), "id")


@REGISTER(
    f"""WITH {_GROUPS} SELECT cluster_id, CASE WHEN bytes > {answers.PROMPT_BYTES} THEN 'prompt too long' ELSE CASE turn WHEN 4 THEN 'no text: merged_text' WHEN 5 THEN 'no text: reasoning' WHEN 6 THEN 'unknown decision' WHEN 7 THEN 'no text: clear_winner' WHEN 8 THEN 'no object' WHEN 9 THEN 'malformed' WHEN 10 THEN 'malformed' WHEN 11 THEN 'no answer' END END AS fault,
CASE WHEN bytes <= {answers.PROMPT_BYTES} THEN CASE turn WHEN 0 THEN 'merge' WHEN 1 THEN 'keep_separate' WHEN 2 THEN 'contradiction' WHEN 3 THEN 'contradiction' END END AS decision,
CASE WHEN bytes <= {answers.PROMPT_BYTES} AND turn = 0 THEN c || ' in one' END AS merged_text, CASE WHEN bytes <= {answers.PROMPT_BYTES} AND turn = 2 THEN last END AS winner FROM groups"""
)
def merge_decisions(spark, d):
    """Clusters of neighbouring facts, asked about and read: a decision or the fault of each."""
    m, members = _members(spark, d)
    return answers.decide_merges(members, m, MergingModel).select("cluster_id", "fault", "decision", "merged_text", "winner")


@REGISTER(f"WITH {_GROUPS} SELECT g.cluster_id, m.id, m.content FROM groups g JOIN member m USING (cluster_id) WHERE bytes <= {answers.PROMPT_BYTES}")
def merge_prompts(spark, d):
    """The facts as a model reads them from the prompt of their cluster."""
    m, members = _members(spark, d)
    read = F.from_json("prompt", "memories array<struct<id:string,content:string>>")["memories"]
    told = answers.merge_prompts(members, m).select("cluster_id", read.alias("facts")).where("facts is not null")
    return told.select("cluster_id", F.inline("facts"))
