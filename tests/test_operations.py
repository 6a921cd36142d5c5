import json
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from engram.__main__ import main
from engram.operators import bm25, outbox, retrieval, stores, transactions
from engram.operators.numbering import numbered
from engram.sources.schema import schema
from engram.sources.store import CommitConflict, StoreFolder
from engram.timeouts import CONSOLIDATION_SECONDS, JobTimeout, consolidation_seconds, within

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
NOW = F.lit


def fact(key, content="a fact", boundary="a", used=T0, confidence=0.9):
    return (key, content, "semantic", None, boundary, T0, T0, None, confidence, 0, used, None, None, "{}")


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), schema("memories"))


def changes(spark, *rows):
    """``operation, id, content`` in order."""
    made = facts(spark, *[fact(key, content) for _, key, content in rows])
    order = spark.createDataFrame([(i, op, key, content) for i, (op, key, content) in enumerate(rows)], "turn long, operation string, id string, content string")
    return order.join(made.drop("content").dropDuplicates(["id"]), "id").withColumn("embedding", F.array(F.lit(1.0).cast("float")))


def now():
    return F.lit("2025-02-01T00:00:00+00:00").cast("timestamp")


def test_numbers_are_dense_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = [(r.k, r.n) for r in numbered(rows, ["k"], "n", 5).collect()]
    assert sorted(got) == [(k, k + 5) for k in range(1000)]
    assert numbered(rows.limit(0), ["k"], "n").count() == 0


def test_commit_judges_changes_in_order(spark):
    told = [("update", "x", "early"), ("write", "x", "one"), ("write", "x", "two"), ("update", "x", "three"), ("delete", "x", "-"), ("delete", "x", "-"), ("update", "y", "new"), ("write", "y", "no"), ("turn", "z", "odd"), (None, "w", "none"), ("write", "z", "zed")]
    made = transactions.commit(facts(spark, fact("y", "old"), fact("k", "kept")), changes(spark, *told), now(), first_seq=10)
    assert [(r.turn, r.fault) for r in made.refused.orderBy("turn").collect()] == [(0, "missing"), (2, "exists"), (5, "missing"), (7, "exists"), (8, "unknown operation"), (9, "unknown operation")]
    assert {(r.id, r.content) for r in made.memories.collect()} == {("y", "new"), ("k", "kept"), ("z", "zed")}
    assert [(r.seq, r.event_type) for r in made.events.orderBy("seq").collect()] == [(10, "memory.create"), (11, "memory.update"), (12, "memory.delete"), (13, "memory.update"), (14, "memory.create")]
    assert made.pending.count() == 0 and not made.overflowing
    payloads = {r.sequence_id: r.payload for r in made.queue.collect()}
    assert json.loads(payloads[10]) == {"embedding": [1.0], "boundary": "a"} and payloads[12] is None
    made.forget()


def test_overflow_is_told_once(spark):
    told = changes(spark, ("write", "x", "1"), ("write", "y", "1"), ("update", "y", "2"), ("update", "y", "3"))
    made = transactions.commit(facts(spark), told, now(), depth=9, most=10)
    assert [(r.seq, r.event_type) for r in made.events.orderBy("seq").collect()] == [(1, "memory.create"), (2, "memory.create"), (3, transactions.OVERFLOW), (4, "memory.update"), (5, "memory.update")]
    assert [(r.memory_id, r.sequence_id) for r in made.queue.collect()] == [("x", 1)]
    assert [(r.memory_id, r.sequence_id) for r in made.pending.collect()] == [("y", 5)]
    assert made.overflowing
    # A queue that is still full says nothing more; one with room again does.
    again = transactions.commit(facts(spark), told, now(), depth=10, most=10, overflowing=True)
    assert again.events.where(F.col("event_type") == transactions.OVERFLOW).count() == 0 and again.overflowing
    eased = transactions.commit(facts(spark), told, now(), depth=9, most=10, overflowing=True)
    assert eased.events.where(F.col("event_type") == transactions.OVERFLOW).count() == 1


def test_commit_without_changes(spark):
    made = transactions.commit(facts(spark, fact("x")), changes(spark, ("write", "y", "1")).limit(0), now(), overflowing=True, depth=outbox.MAX_DEPTH)
    assert made.memories.count() == 1 and made.events.count() == 0 and made.overflowing


def test_store_commits_all_or_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = StoreFolder(spark, path)
    assert store.read("memories").count() == 0
    store.commit(memories=facts(spark, fact("x")), vectors=spark.createDataFrame([("x", [1.0], "a")], schema("vectors")))
    other = StoreFolder(spark, path)
    store.commit(memories=facts(spark, fact("x"), fact("y")))
    with pytest.raises(CommitConflict):
        other.commit(memories=facts(spark))
    # Reads stay at the manifest that was read.
    assert other.read("memories").count() == 1 and StoreFolder(spark, path).read("memories").count() == 2
    assert StoreFolder(spark, path).read("vectors").count() == 1
    for n in range(3):
        store.commit(memories=facts(spark, fact(str(n))))
    store.sweep()
    names = [p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")]
    assert len([n for n in names if n.startswith("manifest-")]) == 2 and len([n for n in names if n.startswith("memories-")]) == 2
    assert StoreFolder(spark, path).read("memories").first().id == "2"


@pytest.fixture
def shell(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/store"

    def run(*args):
        code = main(["--store", path, "--now", "2026-06-01", *args], spark)
        return code, capsys.readouterr().out.strip().splitlines()

    run.store = lambda: StoreFolder(spark, path)
    return run


def test_dead_letters_by_command(spark, shell):
    row = lambda key, op, payload: (key, f"m{key}", op, "no answer", 8, T0, T0, payload, None, None)
    letters = [row("1", "write", '{"embedding":[1.0,0.0],"boundary":"a"}'), row("2", "write", "odd"), row("3", "delete", None), row("4", "write", None)]
    shell.store().commit(dead_letter=spark.createDataFrame(letters, schema("dead_letter")), vectors=spark.createDataFrame([("m3", [1.0], "a")], schema("vectors")))
    assert [json.loads(x)["id"] for x in shell("dead-letter", "list")[1]] == ["1", "2", "3", "4"]
    assert json.loads(shell("dead-letter", "inspect", "2")[1][0])["payload"] == "odd"
    assert [shell("dead-letter", "retry", k) for k in "1233"] == [(0, ["retried_succeeded"]), (0, ["retried_failed"]), (0, ["retried_succeeded"]), (0, ["already retried_succeeded"])]
    assert shell("dead-letter", "acknowledge", "4", "--reason", " ")[0] == 1
    assert shell("dead-letter", "acknowledge", "4", "--reason", "lost")[1] == ["acknowledged: lost"]
    assert shell("dead-letter", "list")[1] == [] and shell("dead-letter", "retry", "9")[0] == 1
    assert [(r.id, r.embedding) for r in shell.store().read("vectors").collect()] == [("m1", [1.0, 0.0])]


def test_consolidation_by_command(spark, shell):
    new = datetime(2026, 5, 30, tzinfo=timezone.utc)
    shell.store().commit(memories=facts(spark, fact("x"), fact("y", used=new)), vectors=spark.createDataFrame([("x", [1.0, 0.0], "a"), ("z", [0.0, 1.0], "a")], schema("vectors")))
    code, said = shell("consolidate", "run")
    assert code == 0
    assert {r.id: r.archived_at is None for r in shell.store().read("memories").collect()} == {"x": False, "y": True}
    assert json.loads(shell("checkpoint", "list")[1][0])["checkpoint_id"] == said[-1]
    assert shell("checkpoint", "rollback", said[-1])[0] == 0
    assert shell("checkpoint", "rollback", said[-1])[0] == 1 and shell("checkpoint", "rollback", "none")[0] == 1
    assert shell.store().read("memories").where("archived_at is not null").count() == 0
    code, said = shell("divergence-check")
    assert code == 1 and [json.loads(x) for x in said[1:]] == [{"id": "z", "missing_in": "memories"}, {"id": "y", "missing_in": "vectors"}]


def test_agents_by_command(shell):
    token = shell("agent", "add", "ann", "--boundary", "a", "--boundary", "b")[1][0]
    assert len(token) == 64 and shell("agent", "add", "ann", "--boundary", "a")[0] == 1
    assert shell.store().read("agent_tokens").where(F.col("token_hash") == token).count() == 0
    assert shell("agent", "set-boundaries", "ann", "--boundary", "c")[0] == 0
    assert json.loads(shell("agent", "list")[1][0])["boundaries"] == ["c"]
    assert [shell("agent", "revoke", name)[0] for name in ("ann", "ann", "bob")] == [0, 1, 1]
    with pytest.raises(SystemExit):
        shell("agent", "add", "eve", "--boundary", "no such!")


def test_time_limit(spark):
    assert within(spark, 60, lambda: spark.range(10).count()) == 10
    assert within(spark, None, lambda: 1) == 1
    slow = F.udf(lambda x: time.sleep(30) or x, "long")
    began = time.time()
    with pytest.raises(JobTimeout):
        within(spark, 1, lambda: spark.range(2).select(slow("id").alias("x")).agg(F.sum("x")).collect())
    assert time.time() - began < 25
    with pytest.raises(ZeroDivisionError):
        within(spark, 60, lambda: 1 / 0)
    assert [consolidation_seconds(x) for x in ("", "x", "-1", "0", " 5 ")] == [CONSOLIDATION_SECONDS] * 3 + [None, 5.0]


def test_retrievers_answer_sound_queries_only(spark):
    stored = facts(spark, fact("x", "green tea"), fact("y", "black coffee"))
    vectors = spark.createDataFrame([("x", [1.0, 0.0], "a"), ("y", [0.0, 1.0], "a")], schema("vectors"))
    asked = spark.createDataFrame([(0, "green tea", [1.0, 0.0], ["a"]), (1, " ", [1.0, 0.0], ["a"]), (2, "green\ttea", [1.0, 0.0], ["a"])], "query_id int, text string, embedding array<float>, scopes array<string>")
    index = bm25.build_index(stored)
    near, words = stores.SemanticRetriever(vectors, stored, now()), stores.KeywordRetriever(index, stored, now())
    both = stores.HybridRetriever(vectors, index, stored, now())
    found = lambda r: {(x.query_id, x.id) for x in r.retrieve(asked, 1).collect()}
    assert found(near) == {(0, "x")} and found(words) == {(0, "x"), (2, "x")} and found(both) == {(0, "x")}
    assert found(stores.AbstainingRetriever(near, index, 99.0)) == set()
    nobody = stores.GraphRetriever(stored, spark.createDataFrame([], schema("entities")), spark.createDataFrame([], schema("relationships")))
    assert found(nobody) == set()
    # The scorer turns the order round; without it the pool keeps its own.
    coffee = lambda q, c: c.select("query_id", "id", F.when(F.col("id") == "y", 5.0).otherwise(-5.0).alias("logit"))
    assert found(stores.RerankedRetriever(both, near, nobody, coffee)) == {(0, "y")}
    assert found(stores.RerankedRetriever(both, near, nobody, lambda q, c: None)) == {(0, "x")}
    with pytest.raises(ValueError):
        near.retrieve(asked, retrieval.MAX_RESULTS + 1)


def test_vector_store_writes_all_or_none(spark):
    store = stores.VectorStore(spark.createDataFrame([("x", [1.0, 0.0], "a")], schema("vectors")), 2)
    with pytest.raises(ValueError, match="dimension"):
        store.upsert(spark.createDataFrame([("y", [1.0, 0.0], "a"), ("z", [1.0], "a")], schema("vectors")))
    more = store.upsert(spark.createDataFrame([("x", [0.0, 1.0], "b"), ("y", [1.0, 0.0], "a")], schema("vectors")))
    assert store.count() == 1 and more.count() == 2 and more.count(["b"]) == 1 and more.count([]) == 0
    ids = spark.createDataFrame([("x",), ("q",), ("x",)], "id string")
    assert {tuple(r) for r in more.contains(ids).collect()} == {("x", True), ("q", False)}
    assert more.delete(ids).count() == 1


def test_graph_store(spark):
    ent = spark.createDataFrame([("e1", "Ann", "person", "a", T0), ("e2", "Bob", "person", "a", T0)], schema("entities"))
    store = stores.GraphStore(ent, spark.createDataFrame([], schema("relationships")))
    edge = ("r1", "e1", "e2", "knows", "a", T0, None, 0.9, "m1")
    store, refused = store.add_relationships(spark.createDataFrame([edge, ("r2", "e1", "e9", "knows", "a", T0, None, 0.9, None)], schema("relationships")))
    assert [r.id for r in refused.collect()] == ["r2"]
    start = spark.createDataFrame([("e1",)], "id string")
    assert [r.entity_id for r in store.traverse(start, ["a"]).collect()] == ["e2"] and store.traverse(start, ["b"]).count() == 0
    assert [r.id for r in store.neighbourhood(start, ["a"]).collect()] == ["r1"]
    again, refused = store.add_entities(spark.createDataFrame([("e3", "Ann", "person", "a", T0), ("e4", "Cy", "person", "a", T0)], schema("entities")))
    assert [r.id for r in refused.collect()] == ["e3"] and again.in_scope(["a"]).count() == 3 and again.by_key("Cy", "person", "a").count() == 1
    ended = store.retire(spark.createDataFrame([("m1",)], "source_memory_id string"), now())
    assert ended.neighbourhood(start, ["a"]).count() == 0
