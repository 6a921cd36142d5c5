from datetime import datetime, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram.functions import clock, jsons, numbers, text, vector
from engram.operators import models
from engram.sources import schema, views


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "v string").select(*columns).first()


@pytest.mark.parametrize(
    ("said", "saved"),
    [
        ("When the user was asked, I prefer tea", "The user prefers tea."),
        ("when asked tea is fine!", "Tea is fine!"),
        ("The user told me that cats purr", "The user cats purr."),
        ("THE USER SAID rain", "The user rain."),
        ("I think that I like that song?", "The user likes that song?"),
        ("I believe it", "It."),
        ("  émile  ", "émile."),
        ("x\n", "X."),
        ("   ", None),
    ],
)
def test_canonical_form(spark, said, saved):
    df = spark.createDataFrame([(said,)], "v string")
    assert text.canonical_form(df, "v", "s").first().s == saved


def test_words_terms_and_queries(spark):
    r = one(spark, "The Cat's  café, no. 42 " + "x" * 41, text.words(F.col("v")), text.index_terms(F.col("v")), text.without_operators(F.lit("a+b \"c\" (d)")))
    assert r[0][:6] == ["the", "cat", "s", "café", "no", "42"] and r[1] == ["cat", "s", "café", "42"] and r[2] == "a b  c   d "


@pytest.mark.parametrize(("raw", "name"), [(" Works  At--Place!", "works_at_place"), ("__x__", "x"), ("!!", ""), ("a" * 63 + "_b", "a" * 63), ("Été", "t")])
def test_relation_name(spark, raw, name):
    assert one(spark, raw, text.relation_name(F.col("v")))[0] == name


def test_cut_bytes_keeps_whole_characters(spark):
    for most in range(0, 12):
        want = "aé😀é😀".encode()[:most].decode("utf-8", "ignore")
        assert one(spark, "aé😀é😀", text.cut_bytes(F.col("v"), most))[0] == want


def test_mentions(spark):
    q = F.array(*[F.lit(w) for w in ("ask", "new", "york", "city")])
    names = [["new", "york"], ["york", "new"], ["york"], ["or"], []]
    got = [one(spark, "", text.mentions(q, F.array(*[F.lit(w) for w in n]).cast("array<string>")))[0] for n in names]
    assert got == [True, False, True, False, False]


def test_times(spark):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    r = one(spark, "", clock.idle_for(at(0), at(10 * 86_400), 10), clock.idle_for(at(1), at(10 * 86_400), 10), clock.expired(at(5), at(5)), clock.expired(F.lit(None).cast("timestamp"), at(5)))
    assert list(r) == [True, False, True, False]
    due = [one(spark, "", F.unix_millis(clock.next_attempt(F.lit(n), at(0), F.lit(j))))[0] for n, j in ((0, 0.0), (7, 1.0), (5, -5.0), (8, 0.0))]
    assert due == [1000, 150_000, 22_500, None]
    texts = ["2025-01-02T03:04:05Z", "2025-01-02T03:04:05.5+02:00", "2025-01-02", "tomorrow", "2025-13-02"]
    got = [one(spark, t, F.unix_micros(clock.as_of(F.col("v"))))[0] for t in texts]
    assert got == [1735787045_000000, 1735779845_500000, 1735776000_000000, None, None]
    now = datetime(2025, 3, 29, 2, 0, tzinfo=timezone.utc)
    assert clock.next_run(now, 3, 0, "Europe/Berlin") == datetime(2025, 3, 30, 1, 0, tzinfo=timezone.utc)


def test_json(spark):
    r = one(spark, '{"b":{"x":1.50},"a\\"":[1,2]}', jsons.with_key(F.col("v"), "b", F.lit("7")), jsons.with_key(F.lit("3"), "k", F.lit('{"z":1}')), jsons.quoted(F.lit('say "hi"\n')))
    import json

    assert json.loads(r[0]) == {"a\"": [1, 2], "b": 7} and r[1] == '{"k":{"z":1}}' and r[2] == '"say \\"hi\\"\\n"'


def test_generators():
    assert numbers.fnv1a("") == "cbf29ce484222325" and numbers.fnv1a("a") == "af63dc4c8601ec8c"
    jitter = numbers.jitter(42)
    assert all(-1 <= next(jitter) < 1 for _ in range(500))
    items = list(range(100))
    drawn = numbers.draw(items, 50, numbers.day_seed(86_400 * 9))
    assert len(set(drawn)) == 50 and drawn == numbers.draw(items, 50, numbers.day_seed(86_400 * 9 + 80_000)) and numbers.draw([], 5, 1) == []


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    r = one(spark, "", vector.cosine(a, b), vector.dot(a, F.array(F.lit(1.0))), vector.cosine(a, F.array(F.lit(0.0), F.lit(0.0))), vector.sigmoid(F.lit(float("nan"))), vector.rrf(F.lit(1), F.lit(None).cast("int")))
    assert r[0] == pytest.approx(0.96) and r[1] == 0 and r[2] == 0 and r[3] == 0 and r[4] == pytest.approx(1 / 61)


def test_validation_reports_each_rule(spark, tiny):
    m = views.memories(spark, tiny).limit(3).withColumn("content", F.lit(" ")).withColumn("boundary", F.lit("no good")).withColumn("confidence", F.lit(float("nan")).cast("float"))
    assert set(schema.validate_memories(m).first().violations) == {"content_empty", "boundary", "confidence"}
    good, bad = schema.quarantine(schema.validate_memories(views.memories(spark, tiny)))
    assert bad.count() == 0 and good.count() > 0
    edges = views.relationships(spark, tiny).limit(2).withColumn("to_entity_id", F.col("from_entity_id"))
    assert schema.validate_relationships(edges).first().violations == ["self_loop"]
    assert schema.validate_vectors(views.vectors(spark, tiny), 32).first().violations == ["dimension"]
    assert schema.validate_entities(views.entities(spark, tiny)).where(F.size("violations") > 0).count() == 0
    assert {t: len(schema.schema(t).fields) for t in ("memories", "audit_log")} == {"memories": 14, "audit_log": 15}


def test_words_of_other_scripts_and_trimming(spark):
    assert one(spark, "नीला Øre x٣", text.words(F.col("v")))[0] == ["नीला", "øre", "x٣"]
    assert one(spark, "\u00a0the user\n", text.is_hub(F.col("v")))[0] and one(spark, " \tA b\u3000", text.name_key(F.col("v")))[0] == "a b"
    assert [one(spark, x, text.has_control(F.col("v")))[0] for x in ("a\u0085b", "a\x07", "a é")] == [True, True, False]
    assert one(spark, "ab\ufffdcd", text.cut_bytes(F.col("v"), 5))[0] == "ab\ufffd"


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), (None,)], "v array<float>")
    assert [r[0] and [round(x, 4) for x in r[0]] for r in df.select(vector.normalised(F.col("v"))).collect()] == [[0.6, 0.8], None]
    with pytest.raises(Exception, match="length zero"):
        spark.createDataFrame([([0.0],)], "v array<float>").select(vector.normalised(F.col("v"))).collect()


def test_fingerprints_of_many_texts_at_once(spark):
    texts = [None if i % 13 == 0 else "aé漢 b"[: i % 6] * (i * i % 97) for i in range(3_000)] + ["z" * 50_000, ""]
    want = [None if t is None else numbers.fnv1a(t) for t in texts]
    assert numbers.fnv1a_all(pa.array(texts, pa.string())).to_pylist() == want
    assert numbers.fnv1a_all(pa.array(texts, pa.string()).slice(7, 900)).to_pylist() == want[7:907]
    assert numbers.fnv1a_all(pa.array([], pa.string())).to_pylist() == [] and numbers.fnv1a_all(pa.array([None, ""], pa.string())).to_pylist() == [None, numbers.fnv1a("")]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", numbers.content_fingerprint(F.col("t")).alias("f")).orderBy("i").collect()
    assert [r.f for r in rows] == want


class Counting:
    """Answers with the number of texts it was given at once."""

    def embed(self, texts):
        return [[len(texts)] for _ in texts]

    def complete_json(self, prompts):
        return [str(len(prompts)) if p else None for p in prompts]


def test_models_get_a_batch_in_slices(spark):
    df = spark.range(0, 1_000, 1, 1).select(F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("t"))
    r = df.select(models.embed(F.col("t"), Counting).alias("e"), models.judge(F.col("t"), Counting).alias("j")).collect()
    assert len(r) == 1_000 and max(x.e[0] for x in r) == models.ASKED and max(int(x.j) for x in r if x.j) == models.ASKED
    assert sum(x.j is None for x in r) == 100
