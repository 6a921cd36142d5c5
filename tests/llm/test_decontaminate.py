import random
import time

import pytest

from engram.llm import decontaminate as dc

RNG = random.Random(2)


def prose(n):
    return [f"w{RNG.randrange(3000)}" for _ in range(n)]


def greedy(item, text, least=dc.SEED):
    """Tiling by trying every pair of starts for the longest run, again and again."""
    mi, mt, marked = [False] * len(item), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and not mi[p + k] and not mt[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        k, p, t = best
        if k < least:
            return marked
        mi[p : p + k], mt[t : t + k] = [True] * k, [True] * k
        marked.append((p, t, k))


def test_tiling_against_plain_search():
    for _ in range(150):
        a = [RNG.randrange(6) for _ in range(RNG.randint(1, 40))]
        b = [RNG.randrange(6) for _ in range(RNG.randint(1, 60))]
        found = dc.tiles(a, b)
        assert all(a[p : p + k] == b[t : t + k] and k >= dc.SEED for p, t, k in found)
        for side in (0, 1):
            places = [x for f in found for x in range(f[side], f[side] + f[2])]
            assert len(places) == len(set(places))
        for least, first in ((dc.SEED, dc.FIRST_SEARCH), (2, 9), (1, 4)):
            assert sorted(dc.tiles(a, b, least, first)) == sorted(greedy(a, b, least))
    item = list(range(40))
    assert sum(k for *_, k in dc.tiles(item, item[20:] + [99] + item[:20])) == 40


@pytest.fixture(scope="module")
def items():
    return [(1, prose(40)), (2, prose(30)), (3, prose(12)), (4, ["a", "b"]), (5, [])]


def frames(spark, items, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    return docs, bench


def test_planted(spark, items, monkeypatch):
    one, two = items[0][1], items[1][1]
    texts = [
        " ".join(prose(50) + one + prose(9)),
        " ".join(prose(20) + one[20:] + prose(5) + one[:20]),
        " ".join(w.upper() + "!" for w in two),
        " ".join(two[:10] + prose(30)),
        " ".join(prose(400)),
        None,
        "",
        "a b",
        " ".join((one + prose(3)) * 50 + two),
        " ".join(one),
        " ".join(one),
    ]
    docs, bench = frames(spark, items, texts)
    want = {(0, 1), (1, 1), (2, 2), (7, 4), (8, 1), (8, 2), (9, 1), (10, 1)}
    assert {(r.doc_id, r.item_id) for r in dc.leak_pairs(docs, bench).collect()} == want
    monkeypatch.setattr(dc, "BLOCK_WORDS", 5)
    assert {(r.doc_id, r.item_id) for r in dc.leak_pairs(docs, bench).collect()} == want
    kept = dc.clean_documents(docs.selectExpr("*", "7 as leaks"), bench)
    assert kept.columns == ["doc_id", "text", "leaks"]
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 6}
    assert dc.leak_pairs(docs, bench.limit(0)).count() == 0
    assert dc.leak_pairs(docs.limit(0), bench).count() == 0


def test_repeated_words_take_no_long_time():
    began = time.time()
    assert dc.tiles([1] * 2000, [1] * 20_000) == [(0, 0, 2000)]
    assert sum(k for *_, k in dc.tiles([1, 2] * 500, ([1] * 7 + [2, 1, 2, 1, 2]) * 1500)) > 800
    assert time.time() - began < 30


def test_short_items(spark):
    docs, bench = frames(spark, [(1, ["one"]), (2, ["two", "words"]), (3, "now three words".split()), (4, []), (5, "now we are five words".split())], ["Now, three words", "one two", "words two words", "", None, "now we are five words"])
    got = {(r.doc_id, r.item_id, r.coverage) for r in dc.leak_pairs(docs, bench).collect()}
    assert got == {(0, 3, 1.0), (1, 1, 1.0), (2, 2, 1.0), (5, 5, 1.0)}


def test_table_against_containment(spark, tiny):
    docs, bench = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet")
    plain = lambda s: " ".join(w for w in map(dc.normalised, s.split()) if w)
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    whole = {(d.doc_id, i) for d in docs.collect() for t in [f" {plain(d.text)} "] for i, x in items if f" {x} " in t}
    got = {(r.doc_id, r.item_id) for r in dc.leak_pairs(docs, bench).where("coverage > 0.99").collect()}
    assert whole and whole <= got
