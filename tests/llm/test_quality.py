import random

import numpy as np

from engram.llm import quality

RNG = random.Random(6)


def rows(n=400):
    out = []
    for i in range(n):
        good = RNG.random() < 0.7
        words = [f"word{RNG.randrange(300)}" for _ in range(RNG.randint(10, 60))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        out.append((i, text, f"src{RNG.randrange(3) + (0 if good else 2)}", "en", len(text), int(good)))
    return out


def tables(spark, n=400, labelled=250):
    data = rows(n)
    docs = spark.createDataFrame([r[:5] for r in data], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("doc_id", "text", "lang as source", "source as lang", "n_chars")
    labels = spark.createDataFrame([(r[0], r[5]) for r in data[:labelled]], "doc_id long, quality int")
    return data, docs, labels


def test_separates_unlabelled_rows(spark):
    data, docs, labels = tables(spark)
    got = {r.doc_id: r for r in quality.quality_digest(docs, labels).collect()}
    assert len(got) == 400
    assert np.mean([got[r[0]].keep == bool(r[5]) for r in data[250:]]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = quality.good_documents(docs.selectExpr("*", "1 as quality_views", "2 as row"), labels)
    assert kept.columns == [*docs.columns, "quality_views", "row"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}


def test_odd_rows_and_too_few_labels(spark):
    _, docs, labels = tables(spark, 60, 40)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "s", "l", 0), (1, "", "s", "l", 0), (2, "w " * 60_000, "s", None, 5)], "doc_id long, text string, source string, lang string, n_chars long")
    assert quality.quality_digest(docs.unionByName(odd), labels).count() == 64
    assert all(r.score == 1.0 for r in quality.quality_digest(odd, labels.limit(0)).collect())
    assert quality.quality_digest(docs.limit(0), labels).count() == 0


def test_views_teach_each_other():
    data = rows(500)
    model = quality.Model(data[:60], [r[:5] for r in data[60:400]])
    p = model.scores([r[1:5] for r in data[400:]])[:, 0]
    assert np.mean((p >= 0.5) == np.array([bool(r[5]) for r in data[400:]])) > 0.95


def test_token_odds_by_plain_counting():
    tokens = [np.array([1, 2]), np.array([2, 3]), np.array([3]), np.array([1, 3]), np.array([], dtype=int), np.array([2])]
    labels, half = {0: 1.0, 1: 0.0, 2: 1.0, 3: 0.0}, np.array([0, 0, 1, 1, 0, 1])
    got, whole = quality.token_odds(tokens, labels, half)

    def weight(bucket, k):
        rate = lambda y: (sum(bucket in tokens[i] for i, v in labels.items() if v == y and half[i] == k) + 1) / (sum(v == y and half[i] == k for i, v in labels.items()) + 2)
        return np.log(rate(1.0)) - np.log(rate(0.0))

    both = lambda b: (weight(b, 0) + weight(b, 1)) / 2
    want = [np.mean([weight(b, 1 - half[i]) if i in labels else both(b) for b in t]) if len(t) else 0.0 for i, t in enumerate(tokens)]
    assert np.allclose(got, want) and np.allclose(whole[:4], [both(b) for b in range(4)])


def test_words_alone_tell_good_from_bad():
    """Texts that differ in no measure, only in their words."""
    data = [(i, " ".join(f"{'ab'[i % 2]}{RNG.randrange(60)}" if RNG.random() < 0.3 else f"c{RNG.randrange(10, 60)}" for _ in range(40)), "s", "en", 100, i % 2) for i in range(400)]
    model = quality.Model(data[:250], [r[:5] for r in data[250:300]])
    p = model.scores([r[1:5] for r in data[300:]])[:, 0]
    assert np.mean((p >= 0.5) == np.array([bool(r[5]) for r in data[300:]])) > 0.95


def test_exchanged_labels_help_a_view():
    """A metadata view that saw few labels learns a source from the text view's sure ones."""
    data = [(i, ("fine words here %d" if i % 2 else "BAD!!! WORDS!!! %d") % RNG.randrange(9), f"src{i % 2}{i % 20}", "en", 20, i % 2) for i in range(400)]
    # Labelled rows come from sources that the others do not have.
    known = [(r[0], r[1], "home", *r[3:]) for r in data[:80]]

    def right(rounds):
        model = quality.Model(known, [r[:5] for r in data[80:300]], rounds=rounds)
        meta = [quality.meta_measures(*r[2:5]) for r in data[300:]]
        guess = model.views[1].logit(model.views[1].code(np.array([[m[1]] for m in meta]), [m[0] for m in meta]))
        return np.mean((guess > 0) == np.array([bool(r[5]) for r in data[300:]]))

    assert right(quality.ROUNDS) > right(0) + 0.2
