import random
from collections import Counter

import numpy as np
import pytest

from engram.llm import near_dedup as nd
from engram.operators.components import connected_components

RNG = random.Random(11)


def shingles(text):
    w = (text or "").encode().split()
    return Counter([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [])


def jaccard(a, b):
    least = sum((a & b).values())
    union = sum((a | b).values())
    return least / union if union else float(a == b)


def brute(rows, similarity=0.8):
    """Class id of each row by all pairs and union-find."""
    bags = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "").split() == (rows[j][1] or "").split() or (bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= similarity - 1e-12):
                root[find(i)] = find(j)
    classes = {}
    for i, (d, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(d)
    return sorted((d, min(classes[find(i)]), len(classes[find(i)])) for i, (d, _) in enumerate(rows))


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in nd.near_classes(df).collect())
    assert got == brute(rows)
    return df


def prose(n, vocabulary=5000):
    return [f"w{RNG.randrange(vocabulary)}" for _ in range(n)]


def edited(words, changes):
    out = list(words)
    for _ in range(changes):
        out[RNG.randrange(len(out))] = f"new{RNG.randrange(10**6)}"
    return out


def test_copies_and_near_copies(spark):
    rows = []
    for _ in range(12):
        base = prose(RNG.randint(60, 300))
        rows += [" ".join(base)] * 2 + [" ".join(edited(base, k)) for k in (1, 2, 3, 5, 9, 20)] + ["\n".join(base)]
    rows += [" ".join(prose(80)) for _ in range(40)]
    RNG.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_chains_of_drifting_copies(spark):
    text, rows = prose(200), []
    for _ in range(40):
        rows.append(" ".join(text))
        text = edited(text, 3)
    RNG.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_weights_count(spark):
    line = prose(12)
    rows = [" ".join(line * k) for k in (1, 2, 3, 9, 10, 11, 40, 44, 70)]
    check(spark, list(enumerate(rows)))


def test_nulls_short_texts_repeats(spark):
    long = " ".join(prose(50))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "a  b"), (6, "a b c"), (7, long), (7, long), (8, long), (9, long + " more")]
    df = check(spark, rows)
    kept = sorted((r.doc_id, r.text) for r in nd.keep_first(df.selectExpr("*", "1 as class_id", "'x' as label", "2 as keep_id")).collect())
    assert kept == [(1, None), (4, "a b"), (6, "a b c"), (7, long)]
    assert nd.near_classes(df.limit(0)).count() == 0
    assert nd.keep_first(df.limit(0)).count() == 0


def test_signature_is_unbiased():
    with np.errstate(over="ignore"):
        rng = np.random.default_rng(0)
        shingle = nd.mix(np.arange(40, dtype=np.uint64) + np.uint64(7))
        for _ in range(3):
            a, b = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
            m, hits = 256, 0
            for trial in range(12):
                s = nd.mix(shingle + np.uint64(1000 * trial))
                sig = [nd.bag_minhash(np.zeros((w > 0).sum(), dtype=np.int64), s[w > 0], w[w > 0], 1, m)[0] for w in (a, b)]
                hits += (sig[0] == sig[1]).sum()
            assert hits / (12 * m) == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 130)] + [(200, 201)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 130)) and got[201] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_table_against_all_pairs(spark, tiny):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    check(spark, rows)


def test_each_class_keeps_its_own_row(spark):
    a, b, c, d, e = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcde")
    rows = [(None, a), (None, a), (None, b), (None, c), (7, d), (7, e), (7, e), (None, d), (None, None), (None, " ")]
    kept = [tuple(r) for r in nd.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted((x for x in kept if (x[1] or "").strip()), key=repr) == sorted([(None, a), (None, b), (None, c), (7, d), (7, e)], key=repr)
    assert len(kept) == 6
