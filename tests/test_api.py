from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from engram import api
from engram.operators import audit
from engram.operators.models import HashEmbedder


@pytest.fixture(scope="module")
def store(spark):
    clock = {"t": datetime(2025, 5, 1, tzinfo=timezone.utc)}

    def now():
        clock["t"] += timedelta(seconds=1)
        return clock["t"]

    return api.FactStore(spark, HashEmbedder(64).embed, now)


def test_life_of_a_fact(store):
    tea = store.memory_write(["work", "home"], "I prefer green tea", "home")
    store.memory_write(["work"], "The printer is on floor two", "work")
    assert tea.split("-")[2][0] == "7"
    found = store.memory_search(["home"], "green tea").collect()
    assert [(r.id, r.content) for r in found] == [(tea, "The user prefers green tea.")]
    # The scope is the caller's, whatever is asked for.
    assert store.memory_search(["work"], "green tea").where("boundary = 'home'").count() == 0
    assert store.memory_search([], "green tea").count() == 0
    with pytest.raises(api.AccessDenied):
        store.memory_write(["work"], "x", "home")
    with pytest.raises(api.AccessDenied):
        store.memory_update(["work"], tea, "x")
    with pytest.raises(api.AccessDenied):
        store.memory_delete(["work"], tea)
    store.memory_update(["home"], tea, "I prefer black tea")
    assert store.memory_search(["home"], "black tea").first().content == "The user prefers black tea."
    assert store.get(["home"], tea).content == "The user prefers black tea." and store.get(["work"], tea) is None
    assert store.memory_read(["home"], "zzz qqq vvv")[2:4] == ([], True)
    said = store.memory_read(["home"], " The user prefers black tea. ")
    assert (said.boundary, said.query, said.abstain, said.status) == ("home", "The user prefers black tea.", False, "degraded")
    assert [f["fact"] for f in said.facts] == ["The user prefers black tea."] and said.warnings == [("home", "report_missing", "warn")]
    assert store.memory_read([], "tea").abstain and store.memory_read([], "tea").status == "ok"
    assert store.memory_delete(["home"], tea) and not store.memory_delete(["home"], tea)
    assert store.memories.count() == store.vectors.count() == 1
    assert {c[0] for c in store.calls} == {"memory_search", "memory_read", "memory_write", "memory_update", "memory_delete"}
    log = store.audit_log()
    assert [r.event_type for r in log.orderBy("seq").collect()] == ["memory.create"] * 2 + ["memory.update"] + ["memory.read"] * 2 + ["memory.delete"]
    assert audit.verify(log).count() == 0


def test_scorer_and_its_absence(spark):
    answers = {"down": False}

    def score(query, texts):
        if answers["down"]:
            raise api.ModelUnavailable
        return [5.0 if "cat" in t.lower() else -9.0 for t in texts]

    reports = spark.createDataFrame([("a", 1, "2025-05-01 00:00:00", False, [])], "boundary string, schema_version int, at string, topic_names_unavailable boolean, topics array<struct<id:string,topic:string>>")
    store = api.FactStore(spark, HashEmbedder(64).embed, lambda: datetime(2025, 5, 1, tzinfo=timezone.utc), score, lambda: reports.withColumn("generated_at", F.to_timestamp("at")))
    ids = [store.memory_write(["a"], f"{x} sleeps here", "a") for x in ("dog", "bird", "cat")]
    assert store.memory_search(["a"], "dog sleeps").first().id == ids[2]
    read = store.memory_read(["a"], "dog sleeps")
    assert len(read.facts) == 3 and not read.abstain and read.status == "ok" and read.warnings == []
    answers["down"] = True
    assert store.memory_search(["a"], "dog sleeps").first().id == ids[0]
    assert len(store.memory_read(["a"], "dog sleeps").facts) == 3


def test_bad_input(store):
    for call in (lambda: store.memory_write(["a"], "  ", "a"), lambda: store.memory_write(["a"], "x", "a", "odd"), lambda: store.memory_write(["a"], "x", "a", confidence=2.0), lambda: store.memory_search(["a"], " ")):
        with pytest.raises(api.InvalidInput):
            call()
    with pytest.raises(api.NotFound):
        store.memory_update(["a"], "nothing", "x")
