import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from engram.llm import lexical

RNG = random.Random(13)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(items, docs, k=lexical.BEST):
    """Every document scored against every item, plainly."""
    counted = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := terms(t))]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked: dict = {}
    for item, text in set(items):
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, query in asked.items():
        rows = []
        for doc, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in query.items() if c[t])
            if s > 0:
                rows.append((-s, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


def text(words, most):
    return RNG.choice([" ", "\n", "—. ", "_"]).join(RNG.choice(words) for _ in range(RNG.randint(0, most)))


def test_varints():
    for values in (np.zeros(0, dtype=np.int64), np.array([0, 1, 127, 128, 16_383, 16_384, 2**31, 2**62]), np.arange(1000)):
        raw, sizes = lexical.varints(values)
        assert sizes.sum() == len(raw) and lexical.from_varints(raw.tobytes()).tolist() == values.tolist()


@pytest.mark.parametrize("shard_bytes", [1, 400, 1 << 20])
def test_as_every_document_scored(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard_bytes)
    words = ["".join(RNG.choice("abCDé中1") for _ in range(RNG.randint(1, 3))) for _ in range(60)]
    docs = [(i, text(words, 30)) for i in range(300)] + [(i, "aa bb Aa") for i in range(400, 430)]
    docs += [(None, "aa bb"), (None, "aa bb"), (None, None), (500, None), (501, ""), (502, " .,_ "), (503, "aa " * 5000), (10, "aa bb"), (-7, "aa bb"), (10, "aa bb")]
    items = [(i, text(words, 8)) for i in range(30)] + [(31, "AA aa bb"), (32, None), (33, ""), (34, "unheard"), (31, "AA aa bb"), (31, "é"), (None, "bb")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id int, text string, rank int").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, shard int")
    made = lexical.search(q, lexical.build_index(d))
    assert made.schema["doc_id"].dataType.simpleString() == "int"
    assert sorted(map(tuple, made.collect()), key=repr) == brute(items, docs)


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    words = ["".join(RNG.choice("abcd") for _ in range(3)) for _ in range(30)]
    docs, items = [(i, text(words, 20)) for i in range(100)], [(i, text(words, 6)) for i in range(20)]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    q = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 25)
    assert sorted(map(tuple, lexical.search(q, index, 3).collect()), key=repr) == brute(items, docs, 3)


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "aa")], "doc_id long, text string"), spark.createDataFrame([(1, "aa"), (2, "bb")], "item_id long, text string")
    assert lexical.search(q, lexical.build_index(d.limit(0))).count() == 0
    assert lexical.search(q.limit(0), lexical.build_index(d)).count() == 0


def test_merge_against_sorting():
    for _ in range(200):
        norms = np.full(50, 75)
        lists, every = [], Counter()
        for _ in range(RNG.randint(1, 6)):
            docs = sorted(RNG.sample(range(50), RNG.randint(1, 50)))
            raw, _ = lexical.varints(np.array([x for a, b in zip([0, *docs], docs) for x in (b - a, RNG.randint(1, 4))]))
            w, q = RNG.randint(1, 3), RNG.randint(1, 2)
            made = lexical._List(raw.tobytes(), w, norms)
            assert made.docs == docs
            lists.append((made, q))
            for d, s in zip(made.docs, made.shares):
                every[d] += q * s
        want = sorted(((-s, d) for d, s in every.items() if s))[:5]
        assert lexical.best_documents(lists, 5) == [(-s, d) for s, d in want]
