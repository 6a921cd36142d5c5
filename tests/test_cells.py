import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import cells, knn
from engram.plans import search
from engram.sources import views

RNG = np.random.default_rng(5)


def rows(found, *names):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in found.select(*names).collect())


def mean_recall(found, exact):
    r = cells.recall(found, exact).agg(F.sum("hits"), F.sum("wanted")).first()
    return r[0] / r[1]


@pytest.fixture(scope="module")
def stored(spark):
    """Some scopes, repeated and zero vectors, one of another dimension, one null."""
    points = RNG.normal(size=(600, 12))
    made = [(f"v{i:04}", [float(x) for x in p], "abc"[i % 3]) for i, p in enumerate(points)]
    made += [(f"w{i:04}", made[0][1], "a") for i in range(40)] + [("zero", [0.0] * 12, "a"), ("odd", [1.0, 2.0], "a"), ("none", None, "b")]
    return spark.createDataFrame(made, "id string, embedding array<float>, boundary string").repartition(4)


@pytest.fixture(scope="module")
def asked(spark):
    made = [(i, [float(x) for x in RNG.normal(size=12)], ["a", "b"] if i % 2 else ["c"]) for i in range(30)]
    made += [(90, [1.0, 2.0], ["a"]), (91, None, ["a"]), (92, [1.0] * 12, []), (93, [1.0] * 12, ["unheard"])]
    return spark.createDataFrame(made, "query_id long, embedding array<float>, scopes array<string>")


def test_exact_and_all_cells_are_the_exact_search(asked, stored):
    same = asked.where("query_id <> 90")
    want = rows(knn.knn(same, stored, 7), "query_id", "id", "score", "rank")
    index = cells.build(stored)
    assert index.rows.count() == stored.count()
    assert rows(cells.search(same, index, 7, probes=1, exact=True), "query_id", "id", "score", "rank") == want
    assert rows(cells.search(same, index, 7, probes=10_000), "query_id", "id", "score", "rank") == want
    other = asked.where("query_id = 90")
    for held in (cells.search(other, index, 2), cells.search(other, index, 2, exact=True)):
        assert rows(held, "id", "score", "rank") == [("odd", 1.0, 1), ("v0000", 0.0, 2)]


def test_probes_find_nine_of_ten_and_read_fewer_cells(spark, tiny):
    q, v = search.vector_queries(spark, tiny), views.vectors(spark, tiny)
    index = cells.build(v)
    assert 1 <= index.centres.probes < len(index.centres.points)
    assert mean_recall(cells.search(q, index, 10), knn.knn(q, v, 10)) >= 0.9


def test_probed_cells_are_the_only_folders_read(asked, stored):
    index = cells.build(stored)
    plan = cells.search(asked.where("query_id = 0"), index, 3, probes=1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell#") or "cell IN" in plan or "(cell#" in plan


def test_upkeep_is_a_fresh_index(spark, asked, stored):
    changed = stored.where("id like 'v00%'").withColumn("embedding", F.transform("embedding", lambda x: -x)).unionByName(spark.createDataFrame([("new", [0.5] * 12, "c")], stored.schema))
    deleted = stored.where("id like 'w%'").select("id")
    now = stored.join(changed, "id", "left_anti").join(deleted, "id", "left_anti").select(*stored.columns).unionByName(changed)
    index = cells.upsert(cells.build(stored), changed, deleted)
    for held in (index, cells.compacted(index)):
        assert sorted(r.id for r in held.rows.collect()) == sorted(r.id for r in now.collect())
        assert rows(cells.search(asked.where("query_id <> 90"), held, 5, probes=1, exact=True), "query_id", "id", "score") == rows(knn.knn(asked.where("query_id <> 90"), now, 5), "query_id", "id", "score")


def test_join_over_all_cells_is_the_exact_join(stored, monkeypatch):
    v = stored.where("id <> 'odd'")
    want = rows(knn.neighbours(v.where("embedding is not null"), 4, 0.4), "boundary", "id", "other", "score")
    monkeypatch.setattr(cells, "JOIN_BLOCK", 50)
    assert rows(cells.neighbours(v, 4, 0.4, probes=10_000), "boundary", "id", "other", "score") == want


def test_join_finds_nine_of_ten(spark, tiny, monkeypatch):
    v = views.vectors(spark, tiny)
    monkeypatch.setattr(cells, "JOIN_BLOCK", 40)
    as_results = lambda f: f.select(F.col("id").alias("query_id"), F.col("other").alias("id"))
    assert mean_recall(as_results(cells.neighbours(v, 10, -1.0)), as_results(knn.neighbours(v, 10, -1.0))) >= 0.9


def test_empty_table(spark, asked, stored):
    index = cells.build(stored.limit(0))
    assert cells.search(asked, index, 3).count() == 0
    assert cells.neighbours(stored.limit(0), 3, 0.0).count() == 0
    assert cells.search(asked.limit(0), cells.build(stored), 3).count() == 0
