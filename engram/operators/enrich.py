"""Enrichment: facts get search aliases, a new vector, and the entities and relations that they name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.jsons import metadata, quoted, with_key
from engram.functions.numbers import content_fingerprint
from engram.functions.text import clean_aliases, embed_text, entity_label, has_control, name_key, relation_name, trimmed
from engram.operators import answers as A
from engram.operators import models
from engram.operators.scope import consolidation_active
from engram.operators.transactions import Commit, commit
from engram.sources.schema import MAX_ENTITY_NAME_BYTES
from engram.sources.shared import materialise
from engram.sources.tables import retire_edges, upsert

NO_ALIASES, NO_VECTOR = "no aliases", "no vector"


def to_enrich(memories: DataFrame) -> DataFrame:
    """Active facts whose stored fingerprint differs from their content's; ``content_fp`` is the new one."""
    facts = memories.where(consolidation_active()).withColumn("content_fp", content_fingerprint(F.col("content")))
    return facts.where(~F.coalesce(metadata(F.col("metadata_json"), "enrichment.content_fp") == F.col("content_fp"), F.lit(False)))


def extracted_entities(answers: DataFrame) -> DataFrame:
    """``memory_id, position, name, entity_type``: sound entities of each answer (``memory_id, json``), the first spelling kept."""
    items = answers.select("memory_id", F.posexplode(A.items(A.parsed(F.col("json")), "$.entities")).alias("position", "e"))
    named = items.select("memory_id", "position", trimmed(A.text(F.col("e"), "$.name")).alias("name"), F.coalesce(entity_label(A.text(F.col("e"), "$.type")), F.lit("concept")).alias("entity_type"))
    sound = named.where((F.col("name") != "") & (F.octet_length("name") <= MAX_ENTITY_NAME_BYTES) & ~has_control(F.col("name")))
    w = Window.partitionBy("memory_id", name_key(F.col("name")), "entity_type").orderBy("position")
    return sound.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") == 1).drop("_turn")


def extracted_relationships(answers: DataFrame) -> DataFrame:
    """``memory_id, position, from_name, from_type, relation, to_name, to_type``: relations between listed entities.

    Ends are matched without case; of one name listed with two types the last spelling
    counts. Loops and repeats go.
    """
    listed = extracted_entities(answers).groupBy("memory_id", name_key(F.col("name")).alias("k")).agg(F.max_by("name", "position").alias("canonical"), F.max_by("entity_type", "position").alias("kind"))
    items = answers.select("memory_id", F.posexplode(A.items(A.parsed(F.col("json")), "$.relationships")).alias("position", "r"))
    end = lambda path: A.text(F.col("r"), path)
    rows = items.select("memory_id", "position", name_key(end("$.from")).alias("kf"), relation_name(end("$.relation")).alias("relation"), name_key(end("$.to")).alias("kt")).where(F.col("relation") != "")
    ends = lambda k, side: listed.select("memory_id", F.col("k").alias(k), F.col("canonical").alias(f"{side}_name"), F.col("kind").alias(f"{side}_type"))
    joined = rows.join(ends("kf", "from"), ["memory_id", "kf"]).join(ends("kt", "to"), ["memory_id", "kt"])
    w = Window.partitionBy("memory_id", "from_name", "relation", "to_name").orderBy("position")
    kept = joined.where("from_name <> to_name").withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") == 1)
    return kept.select("memory_id", "position", "from_name", "from_type", "relation", "to_name", "to_type")


def get_or_create(entities: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities that exist for ``wanted`` (``name, entity_type, boundary``, exact case), and those to create."""
    keys = ["name", "entity_type", "boundary"]
    asked = wanted.select(*keys).distinct()
    return entities.join(asked, keys, "left_semi"), asked.join(entities.select(*keys), keys, "left_anti")


def reconcile_edges(relationships: DataFrame, memories: DataFrame, now: Column) -> DataFrame:
    """Open edges that stem from facts which are no longer active end now."""
    active = memories.where(consolidation_active()).select("id")
    gone = memories.select("id").join(active, "id", "left_anti").withColumnRenamed("id", "source_memory_id")
    return retire_edges(relationships, gone, now)


#: What the model is asked about a fact; its text follows after the last line.
PROMPT = """Read one fact about the user and answer with one JSON object.
"aliases": a few single, generic, lower-case words under which one would search for it.
"entities": what it names, as {"name", "type"} with type person, organization, project, location or concept.
"relationships": links between those entities, as {"from", "relation", "to"}.
Fact:
"""


@dataclass(frozen=True)
class Enriched:
    """``rows``: one row a due fact, written once; the others follow from it. ``commit`` holds the new facts with their events and queue entries."""

    rows: DataFrame
    commit: Commit
    vectors: DataFrame
    entities: DataFrame
    relationships: DataFrame
    counts: DataFrame


def stored_embed_text(memories: DataFrame, out: str = "embed_text") -> DataFrame:
    """Adds the text whose embedding is stored: with the kept aliases where these belong to the present content, else the content."""
    own = F.coalesce(metadata(F.col("metadata_json"), "enrichment.content_fp") == content_fingerprint(F.col("content")), F.lit(False))
    return memories.withColumn(out, embed_text(F.col("content"), F.when(own, metadata(F.col("metadata_json"), "enrichment.aliases"))))


def enriched_rows(due: DataFrame, make_model: Callable[[], models.Judge], make_embedder: Callable[[], models.Embedder], folder: str | None = None, blocks: int = 1) -> DataFrame:
    """``id, boundary, content_fp, json, aliases, embedding, fault`` of the facts ``due``, from prompt to vector.

    Facts of equal content are asked and embedded once. Aliases are what counts: an answer
    without a usable one is a fault, one without entities is none.
    """
    keyed = due.select("id", "boundary", "content_fp", F.sha2("content", 256).alias("_key"))
    contents = materialise(due.groupBy(F.sha2("content", 256).alias("_key")).agg(F.first("content").alias("content")), "contents")
    told = A.ask(contents.select("_key", F.concat(F.lit(PROMPT), "content").alias("prompt")), make_model, folder, blocks).withColumn("_v", A.parsed(F.col("json")))
    names = F.filter(F.transform(A.items(F.col("_v"), "$.aliases"), lambda a: A.text(a)), lambda a: a.isNotNull())
    read = told.withColumn("aliases", clean_aliases(names)).withColumn("early", F.coalesce(A.object_fault(F.col("json"), F.col("_v")), F.when(F.col("aliases") == "", NO_ALIASES)))
    read = materialise(read.select("_key", "json", "aliases", "early"), "answers-read")
    sound = contents.join(read.where(F.col("early").isNull()).select("_key", "aliases"), "_key")
    made = sound.select("_key", models.embed(embed_text(F.col("content"), F.col("aliases")), make_embedder).alias("embedding"))
    # From here on no row carries its text.
    joined = keyed.join(read, "_key", "left").join(made, "_key", "left")
    fault = F.coalesce("early", F.when(F.col("json").isNull(), A.NO_ANSWER), F.when(F.col("embedding").isNull(), NO_VECTOR))
    return joined.select("id", "boundary", "content_fp", "json", "aliases", "embedding", fault.alias("fault"))


def _named_id(mark: str, *parts: Column | str) -> Column:
    """An id that follows from its parts, so a run that is repeated makes the same row."""
    return F.concat(F.lit(mark), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32))


def enrich(
    memories: DataFrame,
    vectors: DataFrame,
    entities: DataFrame,
    relationships: DataFrame,
    make_model: Callable[[], models.Judge],
    make_embedder: Callable[[], models.Embedder],
    now: Column,
    folder: str | None = None,
    blocks: int = 1,
    depth: int = 0,
    first_seq: int = 1,
) -> Enriched:
    """One enrichment pass over all active facts whose content is new.

    Due facts are asked about (see ``answers.ask`` for ``folder`` and ``blocks``), embedded with
    their aliases and written in one go; facts, events, queue entries, vectors, entities and
    edges follow from that one table, so a pass that is lost leaves nothing half done. The
    content is never changed. Open edges of an enriched fact's earlier content end now, also
    where the new answer names nothing, and so do those of facts which are no longer active.
    Entities that exist in the fact's scope are used, others are made. A fact with a fault
    stays as it was and is due again in the next pass.
    """
    rows = materialise(enriched_rows(to_enrich(memories), make_model, make_embedder, folder, blocks), "enriched")
    good = rows.where(F.col("fault").isNull())

    note = F.concat(F.lit('{"aliases":'), quoted(F.col("_aliases")), F.lit(',"content_fp":'), quoted(F.col("_fp")), F.lit("}"))
    told = memories.join(good.select("id", "embedding", F.col("aliases").alias("_aliases"), F.col("content_fp").alias("_fp")), "id")
    changes = told.withColumn("metadata_json", with_key(F.col("metadata_json"), "enrichment", note)).select(*memories.columns, "embedding", F.lit("update").alias("operation"), F.col("id").alias("turn"))
    done = commit(memories, changes, now, depth, first_seq)
    new_vectors = upsert(vectors.select("id", "embedding", "boundary"), good.select("id", "embedding", "boundary"), ["id"])

    answers = good.select(F.col("id").alias("memory_id"), "json")
    scope = memories.select(F.col("id").alias("memory_id"), "boundary", F.col("confidence").cast("double").alias("confidence"))
    keys = ["name", "entity_type", "boundary"]
    wanted = extracted_entities(answers).join(scope.select("memory_id", "boundary"), "memory_id")
    _, missing = get_or_create(entities, wanted)
    fill = {"id": _named_id("e", *keys), "created_at": now}
    made = missing.select(*[fill.get(c, F.col(c) if c in keys else F.lit(None)).cast(entities.schema[c].dataType).alias(c) for c in entities.columns])
    all_entities = entities.unionByName(made)

    # Of entities that share a natural key the least id counts.
    known = all_entities.groupBy(*keys).agg(F.min("id").alias("entity_id"))
    side = lambda s: known.select(F.col("name").alias(f"{s}_name"), F.col("entity_type").alias(f"{s}_type"), "boundary", F.col("entity_id").alias(f"{s}_entity_id"))
    links = extracted_relationships(answers).join(scope, "memory_id")
    for s in ("from", "to"):
        links = links.join(side(s), [f"{s}_name", f"{s}_type", "boundary"])
    links = links.join(good.select(F.col("id").alias("memory_id"), "content_fp"), "memory_id")
    fill = {
        "id": _named_id("r", "from_entity_id", "relation", "to_entity_id", "memory_id", "content_fp", now.cast("string")),
        "relation_type": F.col("relation"), "valid_from": now, "source_memory_id": F.col("memory_id"),
    }
    own = ("from_entity_id", "to_entity_id", "boundary", "confidence")
    fresh = links.select(*[fill.get(c, F.col(c) if c in own else F.lit(None)).cast(relationships.schema[c].dataType).alias(c) for c in relationships.columns])
    ended = retire_edges(relationships, good.select(F.col("id").alias("source_memory_id")), now)
    reconciled = reconcile_edges(ended.drop("retired"), memories, now)
    edges = reconciled.drop("retired").unionByName(fresh)

    count = F.count(F.lit(1))
    parts = [
        memories.agg(F.count_if(consolidation_active()).alias("active")), rows.agg(F.count("embedding").alias("enriched"), F.count("fault").alias("failed")),
        wanted.agg(count.alias("named")), made.agg(count.alias("entities_created")), fresh.agg(count.alias("relationships_created")),
        ended.agg(F.count_if("retired").alias("retired")), reconciled.agg(F.count_if("retired").alias("retired")),
    ]
    sums = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    total = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns])
    counts = total.select(
        "enriched", (F.col("active") - F.col("enriched") - F.col("failed")).alias("skipped"), "failed", "entities_created", (F.col("named") - F.col("entities_created")).alias("entities_reused"),
        "relationships_created", F.col("retired").alias("relationships_retired"),
    )
    return Enriched(rows, done, new_vectors, all_entities, edges, counts)
