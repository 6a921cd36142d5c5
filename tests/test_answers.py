import json

from pyspark.sql import functions as F

from engram.functions.numbers import content_fingerprint
from engram.operators import answers, enrich
from engram.operators.models import CannedJudge
from engram.sources import views
from engram.sources.schema import schema
from engram.sources.shared import shared_path
from tests.test_operators import facts

GOOD = {"decision": "merge", "merged_text": "x", "reasoning": "r"}


def decided(spark, *raw):
    rows = spark.createDataFrame(list(enumerate(raw)), "cluster_id int, json string")
    return {r.cluster_id: r for r in answers.merge_decisions(rows).collect()}


def test_every_way_to_break_the_form(spark):
    raw = [
        json.dumps(GOOD), json.dumps(GOOD | {"merged_text": None}), json.dumps(GOOD | {"reasoning": ["r"]}), '{"decision":"merge","decision":"merge","merged_text":"x","reasoning":"r"}',
        json.dumps(GOOD) + " {}", "null", '"merge"', "", None, '{"reasoning":"r"}', '{"decision":"contradiction","reasoning":"r"}', '{"decision":"contradiction","reasoning":"r","clear_winner":["a"]}',
        '{"decision":"keep_separate","reasoning":"r","clear_winner":5}', " \n" + json.dumps(GOOD | {"reasoning": "ü\"\\  "}) + "\n",
    ]
    got = decided(spark, *raw)
    assert [got[i].fault for i in range(len(raw))] == [
        None, "no text: merged_text", "no text: reasoning", "malformed", "malformed", "no object", "no object", "malformed", "no answer", "unknown decision", None, "no text: clear_winner", None, None,
    ]
    assert got[0].decision == "merge" and got[0].merged_text == "x" and got[1].decision is None
    assert got[10].decision == "contradiction" and got[10].winner is None and got[13].reasoning == "ü\"\\  "
    # Extra columns stay, and an empty table has no decisions.
    empty = spark.createDataFrame([], "cluster_id int, json string, other string")
    assert answers.merge_decisions(empty).columns[:3] == ["cluster_id", "json", "other"] and answers.merge_decisions(empty).count() == 0


class Counting(CannedJudge):
    """Notes every prompt that it is asked in a folder that the test reads."""

    def __init__(self, answers, folder):
        super().__init__(answers)
        self.folder = folder

    def complete_json(self, prompts):
        import uuid

        for p in prompts:
            (self.folder / uuid.uuid4().hex).write_text(p)
        return super().complete_json(prompts)


def test_a_model_is_asked_once_per_prompt_over_all_runs(spark, tmp_path):
    log, kept = tmp_path / "log", shared_path(spark, "answers")
    log.mkdir()
    make = lambda: Counting({"tea": "1", "milk": "2"}, log)
    rows = spark.createDataFrame([(1, "tea"), (2, "tea"), (3, "milk"), (4, "rum"), (5, None)], "id int, prompt string")
    for _ in range(2):
        got = {r.id: r.json for r in answers.ask(rows, make, kept, blocks=3).collect()}
        assert got == {1: "1", 2: "1", 3: "2", 4: None, 5: None}
    # What was not answered is asked again, all else once.
    assert sorted(f.read_text() for f in log.iterdir()) == ["milk", "rum", "rum", "tea"]
    assert answers.ask(rows.limit(0), make, kept).count() == 0


def test_prompts_are_bounded_and_whole(spark):
    m = facts(spark, [{"id": i, "content": c} for i, c in [("b", 'say "no"'), ("a", "tea"), ("c", "x" * 50), ("d", "y")]])
    members = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "d"), (3, "a"), (3, "gone")], "cluster_id int, id string")
    got = {r.cluster_id: r for r in answers.merge_prompts(members, m, most=40).collect()}
    assert json.loads(got[1].prompt) == {"memories": [{"id": "a", "content": "tea"}, {"id": "b", "content": 'say "no"'}]}
    assert [got[i].fault for i in (1, 2, 3)] == [None, "prompt too long", "missing fact"] and got[2].prompt is None
    told = answers.decide_merges(members, m, lambda: CannedJudge({"tea": json.dumps(GOOD)}), most=40)
    again = answers.decide_merges(members, m, lambda: CannedJudge({"tea": json.dumps(GOOD)}), most=40)
    ids = [{r.cluster_id: r.new_id for r in t.collect()} for t in (told, again)]
    assert ids[0] == ids[1] and ids[0][1] is not None and ids[0][2] is None
    assert {r.fault: r.clusters for r in answers.fault_counts(told).collect()} == {"prompt too long": 1, "missing fact": 1}


class Silent:
    """Embeds no text that holds the word rum."""

    def embed(self, texts):
        return [None if "rum" in t else [float(len(t))] for t in texts]


def test_enrichment_of_changed_content_replaces_edges(spark):
    say = lambda *names: json.dumps({"aliases": ["Drink ", 3], "entities": [{"name": n, "type": "person"} for n in names], "relationships": [{"from": a, "relation": "Knows", "to": b} for a, b in zip(names, names[1:])]})
    told = {"tea": say("Ann", "bob", "ann"), "milk": say(), "rum": say("Zoe"), "bad": "{", "dull": '{"aliases": [" ", 1]}'}
    rows = [{"id": i, "content": c} for i, c in [("f1", "tea"), ("f2", "milk"), ("f3", "rum"), ("f4", "bad"), ("f5", "dull"), ("f6", "tea"), ("f7", "never asked")]]
    m = facts(spark, rows).withColumn("metadata_json", F.when(F.col("id") == "f7", F.concat(F.lit('{"a":[1.50],"enrichment":{"aliases":"old","content_fp":"'), content_fingerprint(F.col("content")), F.lit('"}}'))).otherwise(F.lit('{"a":[1.50]}')))
    at = views.at(views.EPOCH)
    entities = spark.createDataFrame([("known", "Ann", "person", "en")], "id string, name string, entity_type string, boundary string").withColumn("created_at", at)
    edges = spark.createDataFrame([(f"old{i}", "x", "y", "is", "en", 0.5, i) for i in ("f1", "f2", "f3", "f7", "nobody")], "id string, from_entity_id string, to_entity_id string, relation_type string, boundary string, confidence double, source_memory_id string")
    edges = edges.select("id", "from_entity_id", "to_entity_id", "relation_type", "boundary", at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"), "confidence", "source_memory_id")
    vectors = spark.createDataFrame([("f1", [0.0], "en"), ("f7", [7.0], "en")], "id string, embedding array<float>, boundary string")
    made = enrich.enrich(m, vectors, entities, edges, lambda: CannedJudge(told), Silent, views.now())
    assert {r.id: r.fault for r in made.rows.collect()} == {"f1": None, "f2": None, "f3": "no vector", "f4": "malformed", "f5": "no aliases", "f6": None}
    state = {r.id: json.loads(r.metadata_json) for r in made.commit.memories.collect()}
    assert state["f1"]["enrichment"]["aliases"] == "drink" and state["f1"]["a"] == [1.5] and "enrichment" not in state["f3"] and state["f7"]["enrichment"]["aliases"] == "old"
    assert {r.id: r.content for r in made.commit.memories.collect()} == {r["id"]: r["content"] for r in rows}
    texts = {r.id: r.embed_text for r in enrich.stored_embed_text(made.commit.memories).collect()}
    assert texts["f1"] == "tea Topics: drink" and texts["f3"] == "rum" and texts["f7"] == "never asked Topics: old"
    # The stored text embeds to the stored vector.
    assert {r.id: r.embedding for r in made.vectors.collect()} == {i: [float(len(texts[i]))] for i in ("f1", "f2", "f6")} | {"f7": [7.0]}
    assert [(r.resource_id, r.event_type) for r in made.commit.events.orderBy("seq").collect()] == [(i, "memory.update") for i in ("f1", "f2", "f6")]
    assert {r.memory_id for r in made.commit.queue.collect()} == {"f1", "f2", "f6"}
    # One new entity for both facts; the known one is used; edges of old content and of facts that are gone from it end.
    assert sorted((r.name, r.entity_type) for r in made.entities.collect()) == [("Ann", "person"), ("bob", "person")]
    after = {r.id: r for r in made.relationships.collect()}
    assert {i for i, r in after.items() if i.startswith("old") and r.valid_until is not None} == {"oldf1", "oldf2"}
    fresh = [r for i, r in after.items() if not i.startswith("old")]
    assert sorted((r.source_memory_id, r.relation_type) for r in fresh) == [("f1", "knows"), ("f1", "knows"), ("f6", "knows"), ("f6", "knows")]
    assert {tuple(sorted((r.from_entity_id == "known", r.to_entity_id == "known"))) for r in fresh} == {(False, True)}
    counts = made.counts.first().asDict()
    assert counts == {"enriched": 3, "skipped": 1, "failed": 3, "entities_created": 1, "entities_reused": 3, "relationships_created": 4, "relationships_retired": 2}
    # A second pass asks for the faulty facts alone.
    second = enrich.enrich(made.commit.memories, made.vectors, made.entities, made.relationships, lambda: CannedJudge(told), Silent, views.now())
    assert {r.id for r in second.rows.collect()} == {"f3", "f4", "f5"} and second.counts.first().relationships_retired == 0


def test_enrichment_of_an_empty_store(spark):
    empty = {n: spark.createDataFrame([], schema(n)) for n in ("memories", "vectors", "entities", "relationships")}
    made = enrich.enrich(empty["memories"], empty["vectors"], empty["entities"], empty["relationships"], lambda: CannedJudge({}), Silent, views.now())
    assert made.rows.count() == made.entities.count() == made.relationships.count() == made.vectors.count() == 0
    assert set(made.counts.first()) == {0}
