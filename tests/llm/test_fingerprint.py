import random

import numpy as np
from pyspark.sql import functions as F

from engram.llm import fingerprint as fp
from tests.llm.brute import sha

RNG = random.Random(12)


def prose(n):
    return [f"w{RNG.randrange(10**6)}" for _ in range(n)]


def jaccard(a, b):
    x, y = (({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    """Edited texts by plain Python: order by id descending (nulls last), then text."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        out.append((d, len(t), t, t[: len(t) - cut] + after[:cut], after))
    return out


def test_edited_texts_and_likeness(spark):
    rows = [(i * 3, " ".join(prose(RNG.randint(1, 400)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "é😀" * 50), (1003, "one two"), (None, "no id"), (5, "b"), (5, "a"), (5, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 6), round(r.near_next, 6)) for r in fp.fingerprint_documents(df).collect()]
    want = brute(rows)
    assert sorted(map(repr, ((d, n, s) for d, n, s, _, _ in got))) == sorted(map(repr, ((d, n, sha(e)) for d, n, _, e, _ in want)))
    true = {(d, n, sha(e)): (jaccard(t, e), jaccard(t, after)) for d, n, t, e, after in want}
    single = [g for g in got if g[0] != 5]  # the equal rows of id 5 differ in what follows them
    errors = [abs(a - true[d, n, s][0]) for d, n, s, a, _ in single] + [abs(b - true[d, n, s][1]) for d, n, s, _, b in single]
    assert np.mean(errors) < 0.03 and max(errors) < 0.2


def test_estimate_is_unbiased_at_every_size(spark):
    rows = []
    for n in (6, 15, 40, 120, 600, 3000):
        for share in (0.2, 0.5, 0.8):
            for _ in range(12):
                a = prose(n)
                b = a[: int(n * share)] + prose(n - int(n * share))
                rows.append((" ".join(a), " ".join(b), jaccard(" ".join(a), " ".join(b)), n))
    df = spark.createDataFrame(rows, "a string, b string, j double, n int")
    made = df.select("j", "n", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("e")).collect()
    for n in (6, 15, 40, 120, 600, 3000):
        errors = [r.e - r.j for r in made if r.n == n]
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08, n


def test_equal_texts_and_empty_ones(spark):
    df = spark.createDataFrame([(1, "x y z " * 30), (2, "x y z " * 30), (3, ""), (4, None)], "doc_id long, text string")
    r = {x.doc_id: x for x in fp.fingerprint_documents(df).collect()}
    assert r[1].fingerprint == r[2].fingerprint and len(r[1].fingerprint) == fp.BINS
    assert r[3].fingerprint == r[4].fingerprint == "" and r[4].near_next == 1.0 and r[3].near_next == 0.0 and r[2].near_next == 1.0
    assert fp.fingerprint_documents(df.limit(0)).count() == 0
    one = fp.fingerprint_documents(df.limit(1)).collect()[0]
    assert one.near_next == 1.0


def test_stays_in_the_jvm(spark, tiny):
    plan = fp.fingerprint_documents(spark.read.parquet(f"{tiny}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
