import random

import pytest
from pyspark.sql import functions as F

from engram.operators import components

RNG = random.Random(8)


def brute(edges):
    """Union by relabelling."""
    label = {}
    for a, b in edges:
        x, y = label.setdefault(a, a), label.setdefault(b, b)
        low, high = min(x, y), max(x, y)
        for n in [n for n, l in label.items() if l == high]:
            label[n] = low
    return label


def found(spark, edges, kind="string"):
    rows = spark.createDataFrame(edges, f"a {kind}, b {kind}")
    return {r.node: r.label for r in components.connected_components(rows, "test").collect()}


@pytest.mark.parametrize("hub, sent", [(50_000, 500_000), (3, 500_000), (3, 0)])
def test_as_union_of_sets(spark, monkeypatch, hub, sent):
    monkeypatch.setattr(components, "HUB", hub)
    monkeypatch.setattr(components, "BROADCAST_ROWS", sent)
    nodes = [f"n{i:03}" for i in range(120)]
    edges = [(RNG.choice(nodes), RNG.choice(nodes)) for _ in range(90)] + [("hub", n) for n in nodes[:25]] + [("x", "x"), ("x", "x"), ("y", "z"), ("z", "y")]
    assert found(spark, edges) == brute(edges)


def test_null_ends_and_empty(spark):
    assert found(spark, [("a", "b"), ("c", None), (None, None)]) == {"a": "a", "b": "a"}
    assert found(spark, []) == {}


def test_a_large_star_and_a_long_path(spark, monkeypatch):
    """100,000 leaves around the largest id, and a path of 1,500 in no order of ids: rounds are few."""
    monkeypatch.setattr(components, "HUB", 10_000)
    star = spark.range(1, 100_001).select(F.col("id").alias("a"), F.lit(10**9).alias("b"))
    path = spark.range(1_500).select((F.col("id") * 7919 % 1_511 + 2 * 10**9).alias("a"), ((F.col("id") + 1) * 7919 % 1_511 + 2 * 10**9).alias("b"))
    largest = []
    parents = components._parents
    monkeypatch.setattr(components, "_parents", lambda edges, name: largest.append(edges.count()) or parents(edges, name))
    made = components.connected_components(star.union(path), "test")
    sizes = {r.label: r["count"] for r in made.groupBy("label").count().collect()}
    assert len(sizes) == 2 and sizes[1] == 100_001 and min(sizes.values()) == 1_501
    # The first round gives the hub its least leaf, the second the leaves theirs; what is left is the path's.
    assert largest == sorted(largest, reverse=True) and largest[2] < 3_000 and len(largest) <= 9


def test_a_hub_is_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 1_000)
    star = spark.range(1, 20_001).select(F.col("id").alias("a"), F.lit(10**9).alias("b"))
    both = star.union(star.select("b", "a"))
    found = components._parents(both, "test")
    assert found.where("node = 1000000000").first().parts == 20
    # The hub goes to its least leaf, and all others keep an edge to that.
    assert components._contracted(both, found).count() == 2 * 19_999
