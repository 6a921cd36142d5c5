
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.operators import audit, checkpoints, consolidate, divergence, graph, knn, models, outbox, retrieval, topics
from engram.plans import consolidation, queues, search
from engram.sources import shared, tables, views
from engram.streaming import incremental

RNG = np.random.default_rng(5)


def facts(spark, rows):
    """``rows``: dicts over a default fact."""
    base = {"memory_type": "semantic", "source_agent": None, "boundary": "en", "created": 0, "starts": 0, "ends": None, "confidence": 0.5, "access_count": 1, "used": 0, "superseded_by": None, "archived": None, "metadata_json": "{}"}
    whole = [{**base, **r} for r in rows]
    kind = "id string, content string, memory_type string, source_agent string, boundary string, created long, starts long, ends long, confidence float, access_count long, used long, superseded_by string, archived long, metadata_json string"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in kind.split(", ")) for r in whole], kind)
    t = lambda c: F.timestamp_seconds(c)
    return df.select("id", "content", "memory_type", "source_agent", "boundary", t("created").alias("created_at"), t("starts").alias("valid_from"), t("ends").alias("valid_until"), "confidence", "access_count", t("used").alias("last_accessed"), "superseded_by", t("archived").alias("archived_at"), "metadata_json")


def near_vectors(spark, groups, boundary="en"):
    """Vectors in tight groups, ids ``g<i>-<j>``."""
    rows = []
    for g, n in enumerate(groups):
        centre = RNG.standard_normal(32)
        for j in range(n):
            v = centre + RNG.standard_normal(32) * 0.02
            rows.append((f"g{g}-{j}", (v / np.linalg.norm(v)).tolist(), boundary))
    return spark.createDataFrame(rows, "id string, embedding array<float>, boundary string")


def test_consolidation_at_production_floors(spark):
    v = near_vectors(spark, [3, 1, 4])
    rows = [{"id": r.id, "content": f"the user likes tea number {r.id[1]} very much", "created": i, "starts": i, "access_count": i} for i, r in enumerate(v.select("id").orderBy("id").collect())]
    m = facts(spark, rows)
    found = consolidate.clusters(m, v)
    assert {(r.cluster_id, r.id) for r in found.collect()} == {(f"g{g}-0", f"g{g}-{j}") for g, n in ((0, 3), (2, 4)) for j in range(n)}
    plan = consolidate.dedup_plan(found, m, v)
    assert {r.survivor for r in plan.collect()} == {"g0-2", "g2-3"}
    after = consolidate.apply_dedup(m, plan).cache()
    assert after.count() == 8 and after.where("superseded_by is null").count() == 3
    assert after.where("id = 'g0-2'").first().access_count == 3
    # A second run over what is left finds nothing to do.
    assert consolidate.clusters(after, v).count() == 0
    # One odd member stops the whole cluster.
    odd = m.withColumn("content", F.when(F.col("id") == "g0-1", "quite another matter").otherwise(F.col("content")))
    assert {r.cluster_id for r in consolidate.dedup_plan(found, odd, v).collect()} == {"g2-0"}
    swapped = m.withColumn("content", F.when(F.col("id") == "g2-1", "very much the user likes tea number 2").otherwise(F.col("content")))
    assert {r.cluster_id for r in consolidate.dedup_plan(found, swapped, v).collect()} == {"g0-0"}


def test_dropped_neighbours_use_up_places(spark):
    v = near_vectors(spark, [8])
    m = facts(spark, [{"id": f"g0-{j}", "content": "x", "superseded_by": None if j in (0, 7) else "y"} for j in range(8)])
    k1 = consolidate.clusters(m, v, k=1).count()
    assert k1 in (0, 2) and consolidate.clusters(m, v, k=7).count() == 2


def test_incremental_contradictions_and_recency(spark):
    v = near_vectors(spark, [2, 2])
    m = facts(spark, [{"id": f"g{g}-{j}", "content": "x", "created": 10 * j, "starts": 100 - j if g else 5} for g in range(2) for j in range(2)])
    pairs = consolidate.contradiction_pairs(m, v)
    assert {(r.a, r.b) for r in pairs.collect()} == {("g0-0", "g0-1"), ("g1-0", "g1-1")}
    assert consolidate.contradiction_pairs(m, v, F.timestamp_seconds(F.lit(5))).count() == 2
    assert consolidate.contradiction_pairs(m, v, F.timestamp_seconds(F.lit(50))).count() == 0
    verdicts = pairs.select("a", "b", F.lit(True).alias("contradiction"), F.lit("car").alias("shared_attribute"))
    assert {r.stale for r in consolidate.judge_by_recency(pairs, verdicts, m).collect()} == {None, "g1-1"}
    made, refused = consolidate.invalidate(m, spark.createDataFrame([("g1-0",), ("g0-0",)], "id string"), F.timestamp_seconds(F.lit(50)))
    assert [r.id for r in refused.collect()] == ["g1-0"] and made.where("valid_until is not null").count() == 1


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=2, unique=True), st.integers(1, 4))
def test_search_never_leaves_its_scope(spark, scopes, k):
    rows = [(f"v{i:02d}", RNG.standard_normal(8).tolist(), "abc"[i % 3]) for i in range(12)]
    v = spark.createDataFrame(rows, "id string, embedding array<float>, boundary string")
    q = spark.createDataFrame([(1, rows[0][1], scopes)], "query_id int, embedding array<float>, scopes array<string>")
    got = knn.knn(q, v, k).collect()
    inside = [r for r in rows if r[2] in scopes]
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    want = sorted(inside, key=lambda r: (-float(unit(r[1]) @ unit(rows[0][1])), r[0]))[:k]
    assert [r.id for r in sorted(got, key=lambda r: r.rank)] == [r[0] for r in want]


def test_neighbours_in_small_blocks(spark, tiny, monkeypatch):
    v = views.vectors(spark, tiny)
    whole = {tuple(r) for r in knn.neighbours(v, 3, 0.3).select("id", "other").collect()}
    monkeypatch.setattr(knn, "JOIN_BLOCK", 40)
    assert {tuple(r) for r in knn.neighbours(v, 3, 0.3).select("id", "other").collect()} == whole
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    q = search.vector_queries(spark, tiny)
    assert knn.knn(q, v, 5).count() == q.count() * 5


def test_a_search_scores_few_vectors_at_once(spark, monkeypatch):
    v = spark.createDataFrame([(f"v{i:05d}", RNG.standard_normal(8).tolist(), "x") for i in range(5_000)], "id string, embedding array<float>, boundary string").coalesce(1)
    q = v.where("id like '%00'").select(F.col("id").alias("query_id"), "embedding", F.array(F.lit("x")).alias("scopes"))
    want = sorted(map(tuple, knn.knn(q, v, 3).select("query_id", "id", "rank").collect()))
    real = knn._matrix

    def small(column):
        assert len(column) <= 1024
        return real(column)

    monkeypatch.setattr(knn, "_matrix", small)
    assert sorted(map(tuple, knn.knn(q, v, 3).select("query_id", "id", "rank").collect())) == want
    rows = {r.id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in v.collect()}
    for me in ("v00000", "v04900"):
        best = sorted(rows, key=lambda i: (-round(float(rows[i] @ rows[me]), 12), i))[:3]
        assert [i for a, i, _ in sorted(want, key=lambda t: (t[0], t[2])) if a == me] == best


def test_query_checks():
    for text, n in (("", 5), ("a\x07", 5), ("a", 0), ("a", 201), ("é" * 1025, 5)):
        with pytest.raises(ValueError):
            retrieval.check_query(text, n)
    retrieval.check_query("fine", 200)


def test_topics_of_small_and_large_boundaries(spark):
    v = near_vectors(spark, [3, 2, 1]).unionByName(near_vectors(spark, [2], "de").withColumn("id", F.concat(F.lit("d"), "id")))
    m = facts(spark, [{"id": r.id, "content": "c", "boundary": r.boundary} for r in v.collect()])
    got = {(r.boundary, r.label, r.id) for r in topics.topics(m, v).collect()}
    assert {(b, label) for b, label, _ in got} == {("en", "topic_0"), ("en", "topic_1"), ("en", "topic_2"), ("de", "general")}
    assert len(got) == 8
    rows = topics.report_rows(topics.topics(m, v).withColumn("label", F.when(F.col("boundary") == "en", "same").otherwise(F.col("label"))), m, views.now())
    assert rows.where("topic = 'same'").count() == 1


def test_audit_chain_finds_every_tampering(spark, tiny):
    log = audit.seal(queues._log(spark, tiny).orderBy("seq").limit(25)).cache()
    assert audit.verify(log).count() == 0
    first = log.agg(F.min("seq")).first()[0]
    for column in ("details_json", "event_hash", "prev_event_hash", "actor_name"):
        for seq in (first, first + 11, first + 24):
            bad = log.withColumn(column, F.when(F.col("seq") == seq, F.lit("0")).otherwise(F.col(column)))
            assert seq in {r.seq for r in audit.verify(bad).collect()} or seq + 1 in {r.seq for r in audit.verify(bad).collect()}
    assert audit.verify(log.where(F.col("seq") != first + 5)).count() == 1


def test_a_chain_is_sealed_in_ranges(spark, tiny, monkeypatch):
    monkeypatch.setattr(audit, "SEAL_EVENTS", 40)
    events = queues._log(spark, tiny).where("seq < 500").repartition(7)
    log = audit.seal(events, "start")
    rows = log.select("seq", "prev_event_hash", "event_hash", audit.audit_body().alias("body")).orderBy("seq").collect()
    assert len(rows) == events.count() and log.columns == [*events.columns, "prev_event_hash", "event_hash"]
    last = "start"
    for r in rows:
        assert (r.prev_event_hash, r.event_hash) == (last, hashlib.sha256((last + r.body).encode()).hexdigest())
        last = r.event_hash
    assert audit.verify(log, "start").count() == 0
    # No task has seen more than a few ranges.
    assert log.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 200
    assert audit.seal(events.limit(0)).count() == 0


def test_checkpoint_and_rollback(spark, tiny):
    before = views.memories(spark, tiny)
    new = before.limit(1).withColumn("id", F.lit("new"))
    after = before.withColumn("confidence", F.when(F.col("id") < "000000000010", F.lit(0.1).cast("float")).otherwise(F.col("confidence"))).unionByName(new)
    entries = consolidate.create_checkpoint(consolidate.checkpoint_diff(before, after), "c1").cache()
    assert {r.change_type: r["count"] for r in entries.groupBy("change_type").count().collect()} == {"modified": 10, "created": 1}
    back = consolidate.rollback(after, entries)
    assert back.exceptAll(before).count() == 0 and before.exceptAll(back).count() == 0
    with pytest.raises(ValueError):
        consolidate.create_checkpoint(consolidate.checkpoint_diff(before, before), "c2")


def test_stream_equals_batch_and_repeats_change_nothing(spark, tiny, tmp_path):
    q = views.outbox(spark, tiny)
    target = views.vectors(spark, tiny).select(F.col("id").alias("memory_id"), F.lit("old").alias("payload"), F.lit(-1).cast("long").alias("sequence_id"))
    for i in range(3):
        q.where(F.col("sequence_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "queue"))
    states = []
    incremental.apply_stream(incremental.change_stream(spark, str(tmp_path / "queue"), q.schema), target, str(tmp_path / "ck"), states.append)
    assert len(states) == 3
    once = outbox.apply_changes(target, q)
    for other in (outbox.apply_changes(once, q), states[-1]):
        assert once.exceptAll(other).count() == 0 and other.exceptAll(once).count() == 0
    assert outbox.live(once).count() < once.count()


def test_a_late_older_change_does_not_undo_a_delete(spark):
    kind = "memory_id string, sequence_id long, operation string, payload string"
    target = spark.createDataFrame([("a", "old", 1)], "memory_id string, payload string, sequence_id long")
    gone = outbox.apply_changes(target, spark.createDataFrame([("a", 5, "delete", None)], kind))
    late = outbox.apply_changes(gone, spark.createDataFrame([("a", 3, "update", "late")], kind))
    assert outbox.live(late).count() == 0
    again = outbox.apply_changes(late, spark.createDataFrame([("a", 6, "write", "new")], kind))
    assert [tuple(r) for r in outbox.live(again).collect()] == [("a", "new", 6)]
    assert outbox.forget_deleted(late, 6).count() == 0 and outbox.forget_deleted(late, 5).count() == 1


def test_worker_step_drain_and_replay(spark):
    t = lambda s: F.timestamp_seconds(F.lit(s))
    q = spark.createDataFrame([(str(i), f"m{i}", "update", f"p{i}", i, 7 if i == 3 else 0, None) for i in range(1, 6)], "id string, memory_id string, operation string, payload string, sequence_id long, attempts_made int, last_error string")
    q = q.withColumn("next_attempt_at", F.timestamp_seconds(F.col("sequence_id") * 10)).withColumn("created_at", t(0))
    failures = spark.createDataFrame([("2", "no answer", False, 0.0), ("3", "no answer", False, 0.0), ("5", "not due", True, 0.0)], "id string, error string, permanent boolean, jitter double")
    empty = spark.createDataFrame([], "memory_id string, payload string, sequence_id long")
    state, left, dead = outbox.retry_step(empty, q, t(40), failures)
    assert sorted(r.memory_id for r in state.collect()) == ["m1", "m4"]
    assert sorted(r.id for r in left.collect()) == ["2", "5"] and [r.id for r in dead.collect()] == ["3"]
    ids = dead.select("id")
    state, letters = outbox.replay(state, dead, ids, dead.select("id").limit(0), t(50))
    assert sorted(r.memory_id for r in outbox.live(state).collect()) == ["m1", "m3", "m4"] and letters.first().resolution == "retried_succeeded"
    assert outbox.unresolved(letters).count() == 0
    pending = spark.createDataFrame([("a", "x", 3), ("b", None, 1), ("c", "y", 2)], "memory_id string, payload string, queued_at long")
    fits, rest = outbox.drain(outbox.MAX_DEPTH - 1, pending)
    assert [r.memory_id for r in fits.collect()] == ["c"] and sorted(r.memory_id for r in rest.collect()) == ["a", "b"]
    assert outbox.overflow_events(pending, False, t(1)).count() == 1 and outbox.overflow_events(pending, True, t(1)).count() == 0


def test_a_walk_stays_in_the_scope_of_its_query(spark):
    e = spark.createDataFrame([("e1", "Alpha", "y"), ("e2", "Beta", "x"), ("e3", "Gamma", "x")], "id string, name string, boundary string").withColumn("entity_type", F.lit("concept"))
    r = spark.createDataFrame([("r1", "e1", "e2", "y", "m1"), ("r2", "e2", "e3", "x", "m2")], "id string, from_entity_id string, to_entity_id string, boundary string, source_memory_id string")
    r = r.withColumn("relation_type", F.lit("knows")).withColumn("valid_until", F.lit(None).cast("timestamp"))
    m = facts(spark, [{"id": "m1", "content": "one", "boundary": "y"}, {"id": "m2", "content": "two", "boundary": "x", "created": 5}])
    ask = lambda text, *scopes: spark.createDataFrame([(1, text, list(scopes))], "query_id int, text string, scopes array<string>")
    seen = lambda *a: [(x.id, x.explanation) for x in graph.retrieve_graph(ask(*a), m, e, r).orderBy("rank").collect()]
    # Alpha may be named in scope x only where it can be seen; the edge into x lies in y.
    assert seen("alpha", "x") == [] and seen("alpha", "y") == [("m1", "graph: connected via Alpha")]
    assert seen("alpha", "x", "y") == [("m2", "graph: connected via Alpha"), ("m1", "graph: connected via Alpha")]
    moved = e.withColumn("boundary", F.lit("x"))
    assert [x.id for x in graph.retrieve_graph(ask("alpha", "x"), m, moved, r).collect()] == []
    assert graph.traverse(r, e, e.where("id = 'e1'").select("id"), ["x"]).count() == 0
    assert graph.retrieve_graph(ask("alpha", "x", "y"), m, e, r, 1).first().id == "m2"


def test_reading_stops_at_the_candidate_limit(spark):
    e = spark.createDataFrame([("a", "Alpha"), ("b", "Beta")], "id string, name string").withColumn("entity_type", F.lit("concept")).withColumn("boundary", F.lit("x"))
    rows = [(f"r{i:03}", "a", "b" if i % 2 else "a", "x", f"m{i:03}") for i in range(40)] + [("s", "b", "a", "x", "m000")]
    r = spark.createDataFrame(rows, "id string, from_entity_id string, to_entity_id string, boundary string, source_memory_id string").withColumn("relation_type", F.lit("knows")).withColumn("valid_until", F.lit(None).cast("timestamp"))
    m = facts(spark, [{"id": f"m{i:03}", "content": "c", "boundary": "x", "created": i} for i in range(40)])
    got = graph.retrieve_graph(spark.createDataFrame([(1, "alpha beta", ["x"])], "query_id int, text string, scopes array<string>"), m, e, r).orderBy("rank").collect()
    assert [x.id for x in got] == [f"m{i:03}" for i in range(31, -1, -1)]
    assert {x.explanation for x in got} == {"graph: connected via Alpha"}


def test_a_hub_hands_each_query_its_first_links_only(spark):
    place = lambda edge, depth=0: (depth, [edge], 0)
    rows = [("hub", ["x"], f"m{i:03d}", place(f"r{i:03d}")) for i in range(100)] + [("hub", ["x"], "m000", place("r000", 1)), ("hub", ["x"], "twin", place("r031")), ("hub", ["y"], "m099", place("r099"))]
    links = spark.createDataFrame(rows, "start string, scopes array<string>, id string, place struct<depth:int,path:array<string>,position:int>")
    got = graph._first_links(links).collect()
    assert sorted((r.scopes[0], r.id) for r in got) == [("x", f"m{i:03d}") for i in range(graph.MAX_CANDIDATES)] + [("x", "twin"), ("y", "m099")]
    assert all(r.place.depth == 0 for r in got)


def test_checkpoints_are_undone_once(spark, tiny):
    before = views.memories(spark, tiny)
    after = before.withColumn("confidence", F.when(F.col("id") < "000000000010", F.lit(0.1).cast("float")).otherwise(F.col("confidence")))
    heads = spark.createDataFrame([], checkpoints.HEADER)
    heads, stored = checkpoints.record(heads, None, consolidate.checkpoint_diff(before, after), "c1", views.now())
    assert [(r.checkpoint_id, r.status, r.entries) for r in checkpoints.listing(heads).collect()] == [("c1", "active", 10)]
    spent, back = checkpoints.roll_back(heads, stored, after, "c1")
    assert back.exceptAll(before).count() == 0 and spent.first().status == "rolled_back"
    with pytest.raises(checkpoints.AlreadyRolledBack):
        checkpoints.roll_back(spent, stored, back, "c1")
    with pytest.raises(checkpoints.UnknownCheckpoint):
        checkpoints.roll_back(spent, stored, back, "c2")
    assert checkpoints.retained(heads, stored, 0)[1].count() == 0


def test_decay_markers_are_rfc_3339(spark):
    day, now = 86_400, F.timestamp_seconds(F.lit(1000 * 86_400 + 0.25))
    marker = lambda t: '{"decay":{"last_decay_at":%s},"k":1}' % t
    m = facts(spark, [{"id": k, "content": "x", "metadata_json": j} for k, j in {"none": "{}", "bad": marker('"soon"'), "number": marker(1), "old": marker('"1972-01-01T00:00:00+00:00"'), "offset": marker('"1972-09-20T02:00:00+02:00"'), "list": "[]"}.items()])
    plan = consolidate.decay_plan(m, now)
    assert sorted(r.id for r in plan.collect()) == ["bad", "list", "none", "number", "old"]
    after = consolidate.apply_decay(m, plan, now)
    assert after.where("id = 'old'").first().metadata_json == '{"decay":{"last_decay_at":"1972-09-27T00:00:00.250+00:00"},"k":1}'
    assert consolidate.decay_plan(after, F.timestamp_seconds(F.lit(1100 * day))).count() == 0


def test_a_query_without_a_vector_finds_nothing(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], "x")], "id string, embedding array<float>, boundary string")
    q = spark.createDataFrame([(1, None, ["x"]), (2, [1.0, 0.0], ["x"])], "query_id int, embedding array<float>, scopes array<string>")
    assert [(r.query_id, r.id) for r in knn.knn(q, v, 3).collect()] == [(2, "a")]
    assert knn.knn(q.where("query_id = 1"), v, 3).count() == 0


def test_a_read_abstains_without_losing_facts(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    hits = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.1, 2), (2, "a", 0.009, 1), (2, "b", 0.008, 2)], "query_id int, id string, score double, rank int")
    topics = spark.createDataFrame([("a", "t")], "id string, topic string").withColumn("generated_at", views.now())
    read = lambda scorer: sorted(tuple(r) for r in retrieval.structured_read(hits, q, topics, scorer).select("query_id", "abstain", F.coalesce("id", F.lit("-")), F.coalesce("topic", F.lit("-"))).collect())
    assert read(True) == [(1, False, "a", "t"), (1, False, "b", "-"), (2, True, "a", "t"), (2, True, "b", "-"), (3, True, "-", "-")]
    assert [r[1] for r in read(False)] == [False] * 4 + [True]


def test_watermark(spark, tiny):
    m = views.memories(spark, tiny)
    assert incremental.run_since(m, None).count() == m.count()
    w = tables.set_watermark(spark, F.timestamp_seconds(F.lit(views.EPOCH + 6000)))
    assert incremental.run_since(m, w).count() == m.where(F.col("created_at") >= views.at(views.EPOCH + 6000)).count()


def test_models_plug_in(spark):
    df = spark.createDataFrame([("likes tea",), (None,), ("likes tea",)], "t string")
    rows = df.select(models.embed(F.col("t"), models.HashEmbedder).alias("e"), models.judge(F.concat(F.lit("q: "), F.coalesce("t", F.lit(""))), lambda: models.CannedJudge({"tea": '{"decision":"merge"}'})).alias("j")).collect()
    assert rows[0] == rows[2] and len(rows[1].e) == 32 and rows[1].j is None and rows[0].j == '{"decision":"merge"}'


def test_divergence_sample(spark, tiny):
    m, v = views.memories(spark, tiny), views.vectors(spark, tiny).where("id not like '%7'")
    missing = {r.id for r in divergence.sampled_missing(m, v, views.now(), 3).collect()}
    assert missing and all(i.endswith("7") for i in missing)


def test_reports_and_snapshots_on_disk(spark, tiny, tmp_path):
    rows = topics.reports(topics.report_rows(topics.topics(views.memories(spark, tiny), views.vectors(spark, tiny), floor=0.3), views.memories(spark, tiny), views.now()))
    tables.write_reports(rows, str(tmp_path / "r"))
    back = tables.read_reports(spark, str(tmp_path / "r"), rows.schema)
    assert back.count() == rows.count() > 0
    tables.write_snapshot(views.entities(spark, tiny), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == views.entities(spark, tiny).count()


def test_registered_agents(spark):
    tokens = spark.createDataFrame([], "token_hash string, agent_name string, boundaries array<string>, created_at timestamp, revoked_at timestamp")
    agent = spark.createDataFrame([("h", "bot", ["a"])], "token_hash string, agent_name string, boundaries array<string>").withColumn("created_at", views.now()).withColumn("revoked_at", F.lit(None).cast("timestamp"))
    t = tables.set_agent_boundaries(tables.register_agent(tokens, agent), "bot", ["b", "c"])
    assert t.first().boundaries == ["b", "c"]
    assert tables.revoke_agent(t, "bot", views.now()).first().revoked_at is not None


def test_shared_tables(spark):
    t = shared.materialise(spark.range(10), "unit")
    files = t.inputFiles()
    assert t.count() == 10 and files
    shared.drop(t)


def test_groups_too_large_for_pairs_are_returned_whole(spark):
    sizes = {1: 1, 2: 3, 3: 20, 4: 21, 5: 50}
    rows = [(g, f"{g}-{i:02}") for g, n in sizes.items() for i in range(n)]
    pairs, large = consolidate.group_pairs(spark.createDataFrame(rows, "group_id int, id string"))
    assert {r.group_id: r["count"] for r in pairs.groupBy("group_id").count().collect()} == {2: 3, 3: 190}
    assert sorted(map(tuple, large.collect())) == [r for r in rows if r[0] > 3]


def test_every_fact_of_a_large_table_is_judged(spark):
    d = "/root/testdata/sf0.1"
    pairs, large = consolidation.pairwise_judge_pairs(spark, d), consolidation.nary_judge_groups(spark, d)
    judged = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(large.select("id")).distinct()
    assert sorted(r.id for r in judged.collect()) == sorted(r.id for r in views.memories(spark, d).select("id").collect())


def test_deep_hybrid_hits_reach_the_reranker(spark, tiny):
    rows = lambda n: {(r.query_id, r.id) for r in n.select("query_id", "id").collect()}
    deep = rows(search._hybrid(spark, tiny, retrieval.FANOUT)[2].where(F.col("rank") > search.PAGE))
    assert rows(search.retrieve_reranked(spark, tiny)) & deep
