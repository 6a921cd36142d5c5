import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import knn, vector_graph
from engram.plans import search
from engram.sources import views
from tests.test_cells import mean_recall, rows

RNG = np.random.default_rng(9)


def test_codes_are_near():
    x = RNG.normal(size=(50, 8)) * [1, 2, 3, 4, 5, 6, 7, 0]
    codes, low, step = vector_graph.codes_of(x)
    assert np.abs(codes * step + low - x).max() <= step.max() / 2 + 1e-5


@pytest.mark.parametrize("n, dim", [(1, 4), (2, 4), (30, 4), (3000, 64)])
def test_walks_meet_nine_of_ten(n, dim):
    """Random vectors of 64 dimensions are about the hardest case for a graph."""
    x = knn._unit(RNG.normal(size=(n, dim))).astype(np.float32)
    codes, low, step = vector_graph.codes_of(x)
    q = knn._unit(RNG.normal(size=(40, dim)))
    places, _ = vector_graph.walk(codes, vector_graph.links_of(x), low, step, q, vector_graph.EF)
    best = np.argsort(-(q @ x.T), axis=1)[:, :10]
    hits = sum(len(set(b.tolist()) & set(p.tolist())) for b, p in zip(best, places))
    assert hits >= 0.9 * best.size
    assert all(len(set(p[p >= 0].tolist())) == (p >= 0).sum() for p in places)


def test_equal_vectors_do_not_cut_the_graph():
    x = np.concatenate([np.tile(knn._unit(RNG.normal(size=(1, 8))), (500, 1)), knn._unit(RNG.normal(size=(500, 8)))]).astype(np.float32)
    codes, low, step = vector_graph.codes_of(x)
    q = x[700:720].astype(float)
    places, _ = vector_graph.walk(codes, vector_graph.links_of(x), low, step, q, vector_graph.EF)
    assert sum(700 + i in p for i, p in enumerate(places)) >= 18


def test_search(spark, tiny, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD_VECTORS", 50)
    q, v = search.vector_queries(spark, tiny), views.vectors(spark, tiny)
    index = vector_graph.build(v)
    assert index.shards.count() >= 8
    found, exact = vector_graph.search(q, index, v, 10, ef=24), knn.knn(q, v, 10)
    assert mean_recall(found, exact) >= 0.9
    true = {r[:2]: r[2] for r in rows(knn.knn(q, v, 500), "query_id", "id", "score")}
    assert all(true[r[:2]] == r[2] for r in rows(found, "query_id", "id", "score"))


def test_upkeep_and_odd_rows(spark):
    made = [(f"v{i:03}", [float(x) for x in RNG.normal(size=6)], "ab"[i % 2]) for i in range(80)] + [("odd", [1.0], "a"), ("none", None, "a"), ("nowhere", [1.0] * 6, None)]
    v = spark.createDataFrame(made, "id string, embedding array<float>, boundary string")
    q = spark.createDataFrame([(i, [float(x) for x in RNG.normal(size=6)], ["a", "b"] if i else ["b"]) for i in range(9)] + [(20, [1.0], ["a"]), (21, None, ["a"]), (22, [1.0] * 6, [])], "query_id int, embedding array<float>, scopes array<string>")
    changed = v.where("id like 'v00%'").withColumn("embedding", F.transform("embedding", lambda x: -x)).unionByName(spark.createDataFrame([("new", [0.3] * 6, "a")], v.schema))
    now = v.join(changed, "id", "left_anti").where("id not like 'v01%'").select(*v.columns).unionByName(changed)
    index = vector_graph.upsert(vector_graph.build(v), changed)
    want = rows(knn.knn(q.where("query_id < 20"), now.where("id not in ('odd', 'none') and boundary is not null"), 5), "query_id", "id", "score", "rank")
    assert rows(vector_graph.search(q, index, now, 5), "query_id", "id", "score", "rank") == want
    assert vector_graph.search(q, vector_graph.build(v.limit(0)), v, 5).count() == 0
