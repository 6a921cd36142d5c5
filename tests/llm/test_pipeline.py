import corpus_pipeline
from engram.llm import bpe
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.test_near_dedup import brute as near_brute


def test_stages_over_the_small_table(spark, tiny):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "bpe_encoding"]
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, tiny).cache()
        assert docs.columns == columns and docs.schema == before.schema, name
        seen.append({r.doc_id: r for r in docs.collect()})
    good, single, clean, safe = seen
    assert sorted(d for d, c, _ in near_brute([(i, r.text) for i, r in good.items()]) if d == c) == sorted(single)
    assert set(clean) < set(single) and set(safe) == set(clean)
    for i, r in safe.items():
        assert not brute.base_spans(r.text)
        assert r.text == clean[i].text or r.n_chars == len(r.text)
        if not brute.base_spans(clean[i].text) and r.text != clean[i].text:
            assert "[REDACTED]" in r.text
    last = corpus_pipeline.bpe_encoding(spark, docs, tiny).collect()
    model = bpe.load(bpe.public_vocabulary())
    assert len(last) == len(safe)
    assert all(model.decode(r.token_ids) == r.text and r.n_tokens == len(r.token_ids) for r in last)


def test_run_and_odd_rows(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (90_001, "", None, "s", 0), (90_001, "", None, "s", 0), (90_002, "long " * 30_000, "en", "s", 1)], docs.schema)
    docs.unionByName(odd).withColumn("row", F.lit("x")).withColumn("leaks", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tiny}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    made = corpus_pipeline.run(spark, str(tmp_path))
    assert {"row", "leaks", "token_ids", "n_tokens"} <= set(made.columns)
    assert 0 < made.count() <= 64
