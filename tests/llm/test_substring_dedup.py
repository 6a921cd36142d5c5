import random
from collections import Counter

import numpy as np

from engram.llm import substring_dedup as sd
from pyspark.sql import functions as F
from tests.llm.brute import sha

RNG = random.Random(3)
CHUNKS = "chunk long, ids array<long>, lengths array<long>, text binary, sizes binary, anchor binary, symbols array<long>, prints array<int>, times array<byte>"


def brute(texts):
    docs = [(t or "").encode().split() for t in texts]
    windows = Counter(tuple(w[i : i + 35]) for w in docs for i in range(len(w) - 34))
    out = []
    for w in docs:
        gone = set()
        for i in range(len(w) - 34):
            if windows[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def check(spark, texts, ids=None):
    df = spark.createDataFrame([(ids[i] if ids else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in sd.remove_repeats(df).collect())
    assert got == sorted((ids[i] if ids else i, *x) for i, x in enumerate(brute(texts)))


def prose(n, vocabulary=400):
    return " ".join(f"w{RNG.randrange(vocabulary)}" for _ in range(n))


def test_planted_passages(spark):
    exact, shorter = prose(35), prose(34)
    texts = [f"{prose(RNG.randint(0, 90))} {p} {prose(RNG.randint(0, 90))}" for p in (exact, exact, shorter, shorter, prose(60)) for _ in range(4)]
    check(spark, texts)


def test_runs_and_periods(spark):
    texts = ["a " * n for n in (1, 34, 35, 36, 80, 300)] + ["a b " * n for n in (10, 18, 40)] + ["x " + "a " * 50 + "y", "a b c " * 30, "q " * 35 + prose(40)]
    check(spark, texts)


def test_small_alphabets(spark):
    texts = [" ".join(RNG.choice("ab") for _ in range(RNG.randint(0, 400))) for _ in range(30)]
    base = prose(500, 30)
    words = base.split()
    texts += [" ".join(words[RNG.randrange(200) : RNG.randrange(250, 500)]) for _ in range(30)]
    check(spark, texts)


def test_nulls_white_space_copies_and_empty_table(spark):
    long = prose(90)
    check(spark, [None, "", " \t\n", long, long, "é x " * 40, "é x " * 36, long.replace(" ", "\n", 3) + "\x0b\x0c tail"])
    check(spark, [long, long, None], ids=[7, 7, 7])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.remove_repeats(empty).count() == 0


def test_symbols_agree_inside_equal_stretches():
    """A symbol whose support lies in a shared stretch is there in both texts."""
    with np.errstate(over="ignore"):
        for alphabet in (2, 5, 50, 10_000):
            rng = np.random.default_rng(alphabet)
            shared = rng.integers(0, alphabet, 60).astype(np.uint64)
            found = []
            for _ in range(2):
                a, b = rng.integers(0, alphabet, 23), rng.integers(0, alphabet, 17)
                whole = sd.mix(np.concatenate((a.astype(np.uint64), shared, b.astype(np.uint64))) + np.uint64(99))
                sym, lo, hi = sd.recompress(whole, np.zeros(len(whole), dtype=np.int64))
                assert (np.diff(lo) >= 0).all() and (np.diff(hi) >= 0).all()
                found.append({(int(l) - 23, int(h) - 23, int(s)) for s, l, h in zip(sym, lo, hi) if l >= 23 and h <= 83})
            assert found[0] == found[1]


def test_verdicts_rest_on_the_symbols(spark):
    """Windows under an anchor that is not shared are never named: without common symbols nothing is found."""
    p = prose(80)
    rows = spark.createDataFrame([(i, f"{prose(20)} {p}") for i in range(4)], "doc_id long, text string")
    chunks = sd.materialise(rows.repartition(4).mapInArrow(sd._chunks, CHUNKS), "t")
    shared = sd._shared(chunks)
    assert shared.count() == chunks.count() > 1
    # Names that differ from chunk to chunk are shared by no two.
    own = chunks.withColumn("symbols", F.transform("symbols", lambda x: F.xxhash64(x, "chunk")))
    alone = sd._shared(own)
    assert alone.where("size(whole) > 0").join(chunks.where("size(ids) = 1").select("chunk"), "chunk").count() == 0
    assert sd._repeated(chunks, alone).where("size(places) > 0").count() == 0


def test_equal_windows_have_equal_anchors():
    with np.errstate(over="ignore"):
        for alphabet in (1, 2, 4, 30, 5000):
            rng = np.random.default_rng(alphabet)
            common = rng.integers(0, alphabet, 70)
            parts = [np.concatenate((rng.integers(0, alphabet, n), common, rng.integers(0, alphabet, 50 - n))) for n in (0, 13, 50)]
            names = sd.mix(np.concatenate(parts).astype(np.uint64) + np.uint64(5))
            places, sizes, symbols = sd.anchors(names, np.array([120] * 3))
            assert sizes.sum() == len(places) == 3 * 86
            of = {}
            for p, s in zip(places, np.repeat(symbols, sizes)):
                assert of.setdefault(names[p : p + 35].tobytes(), s) == s


def test_small_chunks_and_extra_columns(spark):
    p = prose(60)
    rows = [(i, f"{prose(30)} {p if i % 3 else ''} {prose(9)}", 1, "x") for i in range(30)] + [(None, p, 1, "x"), (None, None, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int, places string")
    got = sorted(((r.n_words, r.n_removed, r.kept_text) for r in sd.remove_repeats(df.repartition(7)).collect()))
    assert got == sorted(brute([r[1] for r in rows]))


def test_a_very_long_text(spark):
    long = prose(450_000, 3000)
    check(spark, [long, prose(50, 3000) + " " + " ".join(long.split()[200_000:200_050]), prose(40)])


def test_table_against_sql(spark, tiny):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({sd.ORACLE})").fetchall())
    got = sorted((r.doc_id, r.n_words, r.n_removed, sha(r.kept_text)) for r in sd.remove_repeats(spark.read.parquet(f"{tiny}/documents.parquet")).collect())
    assert got == want
