import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from engram.operators import consolidate, graph


def same(x, y, cosine, lexical):
    (a, u), (b, v) = x, y
    p, q = set(a), set(b)
    share = len(p & q) / min(len(p), len(q)) if p and q else 0.0
    return sum(i * j for i, j in zip(u, v)) >= cosine and share >= lexical and not (a != b and sorted(a) == sorted(b))


def cluster(rnd, turn):
    """Texts about one centre, near or far, with copies, reorderings, empty texts and vectors off the unit sphere."""
    words, spread = [f"w{i}" for i in range(12)], rnd.choice([0.0, 0.1, 0.2, 0.3])
    out = []
    for _ in range(rnd.randint(1, 7)):
        said = [w for w in words if rnd.random() > spread / 3] if turn % 9 else []
        if rnd.random() < 0.05:
            rnd.shuffle(said)
        v = [1.0] + [rnd.gauss(0, spread) for _ in range(3)]
        n = math.sqrt(sum(i * i for i in v)) * (1.2 if turn % 11 == 0 else 1.0)
        out += [(said, [i / n for i in v])] * rnd.choice([1, 1, 3])
    return out


@pytest.mark.parametrize("block", [1_000, 2])
def test_all_same_equals_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(consolidate, "TEXTS_IN_BLOCK", block)
    rnd = random.Random(5)
    made = {c: cluster(rnd, c) for c in range(250)}
    rows = [(c, f"{c:03}-{i:02}", said, v) for c, facts in made.items() for i, (said, v) in enumerate(facts)]
    facts = spark.createDataFrame(rows, "cluster_id int, id string, said array<string>, embedding array<double>")
    want = {c for c, f in made.items() if len(f) > 1 and all(same(x, y, 0.93, 0.8) for x, y in itertools.combinations(f, 2))}
    got = {r.cluster_id for r in consolidate.all_same(facts, 0.93, 0.8).collect()}
    assert got == want and 20 < len(want) < 230


def test_many_copies_and_an_empty_table(spark):
    n = 100_000
    facts = spark.range(n).select(F.lit(1).alias("cluster_id"), F.format_string("%06d", "id").alias("id"), F.array(F.lit("tea"), F.lit("milk")).alias("said"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    assert [r.cluster_id for r in consolidate.all_same(facts, 0.93, 0.8).collect()] == [1]
    other = facts.limit(1).withColumns({"id": F.lit("x"), "said": F.array(F.lit("rum"))})
    assert consolidate.all_same(facts.unionByName(other), 0.93, 0.8).count() == 0
    assert consolidate.all_same(facts.limit(0), 0.93, 0.8).count() == 0


def test_names_that_begin_alike_or_are_alike(spark):
    """10^5 names of one first word, and one name that 10^5 entities bear."""
    n = F.format_string("%06d", "id")
    alike = spark.range(100_000).select(F.concat(F.lit("a"), n).alias("id"), F.concat(F.lit("Acme "), n).alias("name"), F.lit("en").alias("boundary"))
    equal = spark.range(100_000).select(F.concat(F.lit("b"), n).alias("id"), F.lit("Big-Corp").alias("name"), F.when(F.col("id") < 5, "de").otherwise("en").alias("boundary"))
    few = spark.createDataFrame([("c1", "the user", "en"), ("c2", " - ", "en"), ("c3", "Acme", "en"), ("c4", "Acme 000007 of x", "fr")], "id string, name string, boundary string")
    asked = [(1, "Did acme 000007 (of X) or ACME-000009 buy it?", ["en"]), (2, "the user of big corp", ["en", "de"]), (3, "bigcorp acmes", ["en"]), (4, "acme 000007 of x", ["fr"]), (5, "", ["en"]), (6, None, ["en"])]
    queries = spark.createDataFrame(asked, "query_id int, text string, scopes array<string>")
    got = graph.mentioned_entities(queries, alike.unionByName(equal).unionByName(few)).orderBy("query_id", "entity_turn").collect()
    found = {q: [r.id for r in got if r.query_id == q] for q in range(1, 7)}
    assert found == {1: ["a000007", "a000009", "c3"], 2: [f"b{i:06}" for i in range(8)], 3: [], 4: ["c4"], 5: [], 6: []}
    assert graph.mentioned_entities(queries, few.limit(0)).columns == ["query_id", "id", "scopes", "entity_turn"]
    assert graph.mentioned_entities(queries, few.limit(0)).count() == 0
