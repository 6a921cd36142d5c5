import math
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F

from engram.operators import bm25
from engram.plans import search
from engram.sources import views
from engram.sources.schema import schema

RNG = random.Random(4)
WORDS = "tea coffee green black river stone über naïve café x1".split() + [f"w{i}" for i in range(30)]


def facts(spark, texts):
    """Facts of ``id: content``; the other columns are those of a new fact."""
    rows = spark.createDataFrame(list(texts.items()), "id string, content string")
    return rows.select(*[F.col(f.name) if f.name in ("id", "content") else F.lit(None).cast(f.dataType).alias(f.name) for f in schema("memories").fields])


def brute(texts, asked, k):
    """BM25 of every fact for every query, plainly."""
    docs = {i: [w for w in (t or "").split() if w] for i, t in texts.items()}
    n, average = len(docs), sum(map(len, docs.values())) / max(len(docs), 1)
    df = Counter(w for ws in docs.values() for w in set(ws))
    out = []
    for q, text in asked:
        rows = []
        for i, ws in docs.items():
            tf = Counter(ws)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / average)) for t in set(text.split()) if tf[t])
            if s:
                rows.append((-round(s, 9), i))
        out += [(q, i, round(-s, 6), r) for r, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


def text():
    return " ".join(RNG.choice(WORDS) for _ in range(RNG.randint(0, 25)))


def found(queries, index, k):
    return sorted((r.query_id, r.id, round(r.score, 6), r["rank"]) for r in bm25.search(queries, index, k).collect())


@pytest.mark.parametrize("block_facts, pass_terms", [(8192, 200_000), (7, 200_000), (40, 20)])
def test_search_and_upkeep_as_counted_anew(spark, monkeypatch, block_facts, pass_terms):
    monkeypatch.setattr(bm25, "BLOCK_FACTS", block_facts)
    monkeypatch.setattr(bm25, "PASS_TERMS", pass_terms)
    texts = {f"f{i:03}": text() for i in range(600)} | {"none": None, "empty": "", "long": "tea " * 4000}
    asked = [(i, " ".join(RNG.sample(WORDS, RNG.randint(1, 5)))) for i in range(25)] + [(80, "unheard"), (81, "the of")]
    q = spark.createDataFrame([*asked, (82, None)], "query_id long, text string")
    index = bm25.build_index(facts(spark, texts).repartition(3))
    assert (index.documents, index.total) == (603, sum(len((t or "").split()) for t in texts.values()))
    assert found(q, index, 6) == brute(texts, asked, 6)
    for turn in range(3):
        gone = set(RNG.sample(sorted(texts), 60)) | {"never there"}
        again = {i: text() for i in RNG.sample(sorted(texts), 40)} | {f"new{turn}{j}": text() for j in range(20)}
        texts = {i: t for i, t in texts.items() if i not in gone} | {i: t for i, t in again.items() if i not in gone}
        # An id that is both removed and written again is written.
        index = bm25.upsert_index(index, facts(spark, {i: t for i, t in again.items() if i not in gone}), spark.createDataFrame([(i,) for i in gone], "id string"))
    assert found(q, index, 6) == brute(texts, asked, 6)
    held = {(r.id, r.term): r.tf for r in bm25.postings(index).collect()}
    assert held == {(i, w): n for i, t in texts.items() for w, n in Counter((t or "").split()).items()}
    packed = bm25.compacted(index)
    assert (packed.documents, packed.total, packed.segments) == (index.documents, index.total, 1)
    assert found(q, packed, 6) == brute(texts, asked, 6)


def test_blocks_below_the_last_score_are_not_decoded(monkeypatch):
    """Blocks come in order; after one of short facts that hold the word often, a list of rare mentions is not read."""
    row = lambda block, i, tf, n: bm25._rows(block, [i], np.array([n]), np.array(["tea"], dtype=object), *[np.array([x]) for x in (0, 0, tf)])
    read = []
    monkeypatch.setattr(bm25, "_decoded", lambda raw, f=bm25._decoded: read.append(raw) or f(raw))

    class Shared:
        value = ({"tea": 1.0}, {0: ["tea"]})

    run = bm25._scorer(Shared, 10.0, 1, pa.int64())
    out = list(run(iter([row("a", "x", 9, 9), row("b", "y", 1, 90)])))
    assert out[0].column("id").to_pylist() == ["x"] and len(read) == 1


def test_empty(spark):
    none = facts(spark, {"a": "tea"}).limit(0)
    q = spark.createDataFrame([(1, "tea")], "query_id int, text string")
    index = bm25.build_index(none)
    assert index.documents == 0 and bm25.search(q, index, 3).count() == 0
    index = bm25.upsert_index(index, facts(spark, {"a": "tea"}), none.select("id"))
    assert found(q, index, 3)[0][:2] == (1, "a")
    assert bm25.search(q.limit(0), index, 3).count() == 0
    assert bm25.search(q, bm25.upsert_index(index, none, facts(spark, {"a": ""}).select("id")), 3).count() == 0


def test_no_null_arrays_go_to_python(spark, tiny):
    """Null arrays cost Spark's Arrow writer time that grows with their square."""
    index = bm25.build_index(views.memories(spark, tiny))
    sent = bm25._by_block(index.blocks, index.n_blocks)
    assert sent.schema["ids"].dataType == bm25.BLOCK_SCHEMA["ids"].dataType and sent.columns == bm25.BLOCK_SCHEMA.names
    assert sent.where("ids is null or lengths is null").count() == 0
    assert sent.where(F.size("ids") > 0).count() == index.n_blocks


def test_blocks_take_no_more_terms_than_set(spark, monkeypatch):
    """Long facts come in one batch; a block ends before the fact that is too much for it, and a larger fact has its own."""
    monkeypatch.setattr(bm25, "BLOCK_TERMS", 1000)
    texts = {f"f{i:02}": " ".join(RNG.choice(WORDS) for _ in range(1500 if i == 9 else 300)) for i in range(20)}
    index = bm25.build_index(facts(spark, texts).coalesce(1).sortWithinPartitions("id"))
    sizes = [(r.df, r.most_tf) for r in index.blocks.where(F.col("kind") == bm25.FACTS).orderBy("block").collect()]
    assert sorted(sizes) == [(1, 300), (1, 1500), (3, 900), (3, 900), (3, 900), (3, 900), (3, 900), (3, 900)]
    q = spark.createDataFrame([(1, "tea coffee w3"), (2, "stone")], "query_id long, text string")
    assert found(q, index, 5) == brute(texts, [(1, "tea coffee w3"), (2, "stone")], 5)


def test_texts_are_let_go_of_while_a_block_is_counted(spark, monkeypatch):
    """A block is far from full after ten batches, yet the Arrow memory held is that of the batch read and the one before."""
    caught = SimpleNamespace(select=lambda *_: caught, mapInArrow=lambda run, _: setattr(caught, "run", run))
    monkeypatch.setattr(bm25, "materialise", lambda rows, _: rows)
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    bm25._segment(caught)
    held, start, lists = [], pa.total_allocated_bytes(), [[f"word{i % 17}{j}" for j in range(100)] for i in range(500)]
    one = 500 * 100 * 10

    def batches():
        for n in range(10):
            yield pa.RecordBatch.from_arrays([pa.array([f"{n}-{i}" for i in range(500)]), pa.array(lists, pa.list_(pa.string()))], names=["id", "terms"])
            held.append(pa.total_allocated_bytes() - start)

    made = list(caught.run(batches()))
    assert max(held) < 4 * one
    assert sum(len(i) for b in made for i in b.column("ids").to_pylist() if i) == 5000


def test_passes_are_cut_by_hits_too(spark, monkeypatch):
    """Short queries have few terms, but a task keeps ``k`` hits of each."""
    passes = []
    monkeypatch.setattr(bm25, "_scorer", lambda shared, *rest, f=bm25._scorer: passes.append(len(shared.value[1])) or f(shared, *rest))
    monkeypatch.setattr(bm25, "PASS_HITS", 60, raising=False)
    texts, asked = {f"f{i:02}": text() for i in range(50)}, [(i, "tea") for i in range(40)]
    q = spark.createDataFrame(asked, "query_id long, text string")
    assert found(q, bm25.build_index(facts(spark, texts)), 5) == brute(texts, asked, 5)
    assert len(passes) == 4 and sum(passes) == 40


def test_terms_of_a_search_start_no_other_python_workers(spark, tiny, monkeypatch):
    """Rows from Python objects run in workers of another kind, which stay beside those that score."""
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_: pytest.fail("rows from Python objects"))
    assert search.retrieve_reranked(spark, tiny).count() > 0


def test_words_of_a_block_make_no_python_strings():
    """Where no word comes twice a block has as many words as terms; as Python strings they take more than all its numbers."""
    n, held = 200_000, bm25._Counted()
    for lo in range(0, n, 50_000):
        words = pa.array([f"word{i:09}" for i in range(lo, lo + 50_000)])
        held.add([f"f{lo + i}" for i in range(0, 50_000, 500)], pa.ListArray.from_arrays(pa.array(np.arange(0, 50_001, 500, dtype=np.int32)), words))
    tracemalloc.start()
    made = {t for b in held.rows("x") for t in b.column("term").slice(0, 1).to_pylist() + b.column("term").slice(b.num_rows - 1).to_pylist()}
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {None, f"word{n - 1:09}"} <= made
    # 12 bytes a posting, once as counted and once in order, and the order; a string takes 60 more.
    assert most < 50 * n
