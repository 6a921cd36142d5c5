import random
import re
import zlib
from collections import Counter

import pytest

from engram.llm import spelling

RNG = random.Random(11)
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    """Every word held against every other."""
    count: Counter = Counter()
    for i, text in docs:
        for w in RUN.findall(text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if n >= 2 and len(w) >= 7}
    form, rows = {}, {}
    for w, n in words.items():
        others = sorted((-words[v], v) for v in words if near(w, v))
        best = others[0] if others and -others[0][0] >= 10 * n else None
        form[w] = best and best[1]
        rows[w] = (form[w], n, len(others), best and -best[0])
    out = []
    for w, (f, n, n_near, form_n) in rows.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, f, root, n, n_near, form_n))
    return sorted(out)


def sample(n_docs=60):
    base = ["".join(RNG.choice("abcÉé") for _ in range(RNG.randint(7, 12))) for _ in range(40)] + ["abababab", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "z" * 300, "z" * 299 + "y", "z" * 301]
    chain = ["commonest"] * 30 + ["commonesx"] * 3
    docs = []
    for i in range(n_docs):
        words = [RNG.choice(base[:8] if RNG.random() < 0.8 else base) for _ in range(40)] + RNG.sample(chain, 20)
        for k in range(len(words)):
            if RNG.random() < 0.1:
                w, at = words[k], RNG.randrange(len(words[k]))
                words[k] = RNG.choice([w[:at] + w[at + 1 :], w[:at] + RNG.choice("abcZ") + w[at:], w[:at] + RNG.choice("abc") + w[at + 1 :]])
        docs.append((i, RNG.choice([" ", "1", "—"]).join(words)))
    return docs + [(900, None), (901, ""), (902, "short words only"), (None, docs[0][1]), (3, docs[3][1]), (3, docs[3][1])]


@pytest.mark.parametrize("hot, shard_rows", [(20_000, 40_000), (20, 100), (3, 30)])
def test_as_every_word_against_every_other(spark, monkeypatch, hot, shard_rows):
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "SHARD_ROWS", shard_rows)
    docs = sample()
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    assert sorted(map(tuple, spelling.spelling_forms(rows).select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute(docs)


def test_empty_table(spark):
    assert spelling.spelling_forms(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.spelling_forms(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0


def test_halves_decide(spark):
    """Each pair is found once, whichever half holds the edit."""
    words = [("abcdefgh", 5), ("abcdefgx", 3), ("xbcdefgh", 2), ("abcdxefgh", 2), ("abcdfgh", 4), ("bcdefgha", 9)]
    made = spelling.near_pairs(spark.createDataFrame(words, "word string, n long")).collect()
    assert sorted((r.word, r.near, r.near_n) for r in made) == sorted((a, b, m) for a, n in words for b, m in words if near(a, b))
