import random
import unicodedata

import numpy as np

from engram.llm import language as lg

RNG = random.Random(8)
STEMS = {"aa": ["the", "tion", "ing", "wh", "er"], "bb": ["ção", "que", "os", "ll", "ñe"], "cc": ["sch", "ung", "ü", "keit", "ei"]}


def text(lang, n=30):
    return " ".join("".join(RNG.choice(STEMS[lang]) for _ in range(RNG.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_contract(spark):
    rows = [(i, text(lang), lang) for i, lang in enumerate(RNG.choice(list(STEMS)) for _ in range(240))]
    rows += [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (903, text("cc"), None), (904, text("aa", 30_000), "aa"), (904, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lg.language_digest(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [r for r in rows[:240] if by[r[0]].held_out]
    assert np.mean([by[i].lang_pred == lang for i, _, lang in held]) > 0.95
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "cc"]
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in lg.language_digest(docs).collect()] == [(1, False, "und", 0.0)]
    assert lg.language_digest(docs.limit(0)).count() == 0


def test_training_and_company():
    """Training separates the classes, and a text scores alike alone and among others."""
    texts = [text(x) for x in STEMS for _ in range(20)]
    target = [i for i in range(3) for _ in range(20)]
    net = lg.train(texts, target, list(STEMS))
    langs, scores = lg.predict(texts + [None], net)
    assert np.mean([langs[i] == list(STEMS)[target[i]] for i in range(60)]) > 0.95
    alone = [lg.predict([t], net) for t in texts[:5]]
    assert all(a[0][0] == b and abs(a[1][0] - s) < 1e-5 for a, b, s in zip(alone, langs, scores))


def test_letters_are_what_unicode_calls_letters(spark):
    rows = [(i, t, None) for i, t in enumerate(["½ ²", "Ⅳ ①", "٣ 12", "ª", "ǅ", "कि", "é", "😀 _-", "ⓐ"])] + [(100 + i, text("aa"), "aa") for i in range(8)] + [(200 + i, text("cc"), "cc") for i in range(8)]
    got = {r.doc_id: r.lang_pred for r in lg.language_digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i] == "und" for i in range(9)] == [not any(unicodedata.category(c)[0] == "L" for c in t) for _, t, _ in rows[:9]]


def small(seed):
    rng = np.random.default_rng(seed)
    net = lg.Network(["a", "b", "c"], rng)
    for name in ("table", "recur", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    seg = rng.choice(np.frombuffer(b"abz \xc3\xa9", dtype=np.uint8), (3, 7))
    return net, seg, rng


def test_forward_pass_against_a_plain_one():
    net, seg, _ = small(1)
    h = lg.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    want = np.zeros((7, 3, 3))
    for b in range(3):
        logits = np.tile(net.bias, (7, 1))
        for side, places in ((0, range(7)), (1, range(6, -1, -1))):
            state = np.zeros(h)
            for t in places:
                x, u = net.table[side][seg[b, t]], state @ net.recur[side]
                z, r = sig(x[:h] + u[:h]), sig(x[h : 2 * h] + u[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(x[2 * h :] + r * u[2 * h :])
                logits[t] += state @ net.out[side * h : (side + 1) * h]
        e = np.exp(logits)
        want[:, b] = e / e.sum(axis=1, keepdims=True)
    assert np.allclose(net.probabilities(seg), want, atol=1e-6)


def test_gradients_against_differences():
    net, seg, rng = small(2)
    label = np.array([0, 2, 1])
    grads, _ = lg.gradients(net, seg, label)
    for name, grad in zip(("table", "recur", "out", "bias"), grads):
        weights = getattr(net, name)
        some = [tuple(x) for x in np.argwhere(np.abs(grad) > 1e-6)]
        assert some
        for at in rng.choice(some, 8):
            at, keep, loss = tuple(at), weights[tuple(at)], []
            for step in (1e-5, -1e-5):
                weights[at] = keep + step
                loss.append(lg.gradients(net, seg, label)[1])
            weights[at] = keep
            assert abs((loss[0] - loss[1]) / 2e-5 - grad[at]) < 1e-6 + 1e-4 * abs(grad[at]), name


def test_equal_and_repeated_rows(spark):
    rows = [(i // 2, text(x), x) for i, x in enumerate(["aa", "bb"] * 20)] + [(7, "same text", "aa")] * 3
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, language string")
    got = lg.identify(docs, lg.fit_from_table(docs)).collect()
    assert len(got) == 43 and len({tuple(r.language) for r in got if r.text == "same text"}) == 1
