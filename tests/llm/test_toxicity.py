import random

import numpy as np

from engram.llm import sampling, toxicity

RNG = random.Random(4)


def corpus(n=240):
    rows = []
    for i in range(n):
        words = [f"w{RNG.randrange(120)}" for _ in range(RNG.randint(5, 80))]
        toxic = i % 3 == 0
        if toxic:
            words[RNG.randrange(len(words))] = RNG.choice(["nasty", "vile!", "Rotten", f"beastly{RNG.randrange(999)}"])
        rows.append((i, " ".join(words), "en" if i % 2 else "de", int(toxic)))
    return rows


def test_learns_and_generalises(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_digest(docs, labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(got) == len(rows) and 20 < len(held) < 120
    assert np.mean([got[i].predicted == t for i, _, _, t in held]) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    fold = sampling.held_out(docs["doc_id"])
    import zlib

    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs.select("doc_id", fold.alias("h")).collect())


def test_scores_use_text_alone_and_odd_rows(spark):
    rows = corpus(90)
    model = toxicity.fit(rows)
    docs = spark.createDataFrame(
        [(1, "w1 nasty w2", "en", "a"), (2, "w1 nasty w2", None, "b"), (None, None, "de", "c"), (4, "", None, None), (4, "", None, None), (5, "x " * 60_000 + "vile", "fr", "d")],
        "doc_id long, text string, lang string, toxicity string",
    )
    made = toxicity.score_documents(docs, model).collect()
    assert len(made) == 6 and made[0].toxicity == made[1].toxicity and made[2].toxicity == made[3].toxicity
    assert all(0 <= r.toxicity <= 1 for r in made)
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_neighbours_do_not_count():
    model = toxicity.fit(corpus(120))
    texts = [toxicity.words_of(t) for t in ("w1 w2 nasty", "", "w3", "vile w9 w4", "w7 w8")]
    alone = [toxicity.Scorer(model).scores([t])[0] for t in texts]
    for order in ([0, 1, 2, 3, 4], [3, 1, 0, 4, 2], [4, 3, 2, 1, 0]):
        got = toxicity.Scorer(model).scores([texts[i] for i in order])
        assert np.allclose(got, [alone[i] for i in order], atol=1e-6)


def test_no_or_one_label():
    assert toxicity.fit([]).prior == 0.0
    assert toxicity.fit([(1, "a", "en", 1)]).prior == 1.0


def network(seed):
    rng = np.random.default_rng(seed)
    model = toxicity.Model(rng)
    for name in ("embed", "conv", "bias", "out", "out_bias"):
        setattr(model, name, getattr(model, name).astype(np.float64) * (20 if name == "embed" else 1))
    model.bias += rng.standard_normal(model.bias.shape) * 0.1
    rows = np.array([toxicity.buckets(w) for w in ["", "a", "bee", "ceasar", "delta", "wonderful"]])
    return model, rows, [rng.integers(1, 6, n) for n in (1, 2, 5, 9)], rng


def test_forward_pass_against_a_plain_one():
    model, rows, texts, _ = network(1)
    got = model.raw(model.pool(model.answers(rows)[(flat := toxicity._flat(texts))[0]], flat[1]))
    want = []
    for t in texts:
        e = [model.embed[rows[w]].mean(axis=0) for w in t] + [np.zeros(toxicity.SIZE)] * toxicity.BLANKS
        x = 0.0
        for w, k in enumerate(toxicity.WIDTHS):
            first = sum(toxicity.WIDTHS[:w])
            for f in range(toxicity.FILTERS):
                best = max(sum(e[i + j] @ model.conv[first + j, :, f] for j in range(k)) for i in range(len(t) + 1))
                x += max(0.0, best + model.bias[w, f]) * model.out[w * toxicity.FILTERS + f]
        want.append(1 / (1 + np.exp(-(x + model.out_bias[0]))))
    assert np.allclose(got, want, atol=1e-6)


def test_gradients_against_differences():
    model, rows, texts, rng = network(2)
    y, weight = np.array([1.0, 0.0, 0.0, 1.0]), np.array([0.5, 1.0, 0.3, 0.2])
    touched, d_embed, grads, _ = toxicity.gradients(model, texts, rows, y, weight)
    whole = np.zeros_like(model.embed)
    whole[touched] = d_embed
    for name, grad in zip(("embed", "conv", "bias", "out", "out_bias"), [whole, *grads]):
        weights = getattr(model, name)
        some = [tuple(x) for x in np.argwhere(np.abs(grad) > 1e-6) if name != "embed" or x[0] > 0]
        assert some
        for at in rng.choice(some, 8):
            at, keep, loss = tuple(at), weights[tuple(at)], []
            for step in (1e-6, -1e-6):
                weights[at] = keep + step
                loss.append(toxicity.gradients(model, texts, rows, y, weight)[3])
            weights[at] = keep
            assert abs((loss[0] - loss[1]) / 2e-6 - grad[at]) < 1e-5 + 1e-3 * abs(grad[at]), name


def test_samples_are_bounded_and_tell_ids_apart(spark, monkeypatch):
    ids = spark.range(4000).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as y")
    drawn = sampling.by_class(ids, "y", 200).groupBy("y").count().collect()
    assert all(100 < r["count"] < 300 for r in drawn) and len(drawn) == 2
    twice = ids.where("doc_id < 40").unionByName(ids.where("doc_id < 40").withColumn("y", ids["y"] * 0))
    once = sampling.by_class(twice, "y", 500, True).collect()
    assert len(once) == 40 and {r.doc_id for r in once if r.y == 1} == {0, 10, 20, 30}
    docs = spark.createDataFrame([(i % 5, "x" * (10 * (i + 1))) for i in range(10)] + [(9, "y" * 200), (8, None)], "doc_id long, text string")
    wanted = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, y int")
    got = {r.doc_id: r.text for r in sampling.texts_of(docs, wanted, "text").collect()}
    assert got == {**{i: "x" * (10 * (i + 1)) for i in range(5)}, 9: "y" * 200, 8: None}
    monkeypatch.setattr(sampling, "MOST_TEXT_BYTES", 100)
    monkeypatch.setattr(sampling, "MOST_SAMPLE_BYTES", 100)
    some = sampling.texts_of(docs, wanted, "text").collect()
    assert sum(len(r.text or "") for r in some) <= 100 and 9 not in {r.doc_id for r in some}


def test_repeated_and_conflicting_labels(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([r[:3] for r in rows + rows[:20]], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(r[0], 0) for r in rows[:30]] + [(None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_digest(docs, labels).collect()
    assert len(got) == 80 and len({(r.doc_id, r.score) for r in got}) == 60
