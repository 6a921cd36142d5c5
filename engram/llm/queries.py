"""The driver's queries on the text tables and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from engram.llm import bpe, decontaminate, fingerprint, html_extract, language, lexical, near_dedup, pieces, quality, secrets, secrets_sql, spelling, substring_dedup, toxicity
from engram.llm.native import sha256_hex
from engram.sources.shared import table


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.public_vocabulary())
    return made.select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        sha256_hex(F.array_join("token_ids", ",")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.page_digest(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_digest(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "n_removed", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pieces.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.public_model())
    return made.select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        sha256_hex(F.array_join("token_ids", " ")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), lexical.build_index(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_bpe": op2_bpe,
    "op3_html": op3_html,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_secrets": op8_secrets,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality": op10_quality,
    "op11_spelling": op11_spelling,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_lexical": op13_lexical,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op8_secrets": secrets_sql.ORACLE,
    "op9_near_dedup": near_dedup.ORACLE,
    "op11_spelling": spelling.ORACLE,
    "op13_lexical": lexical.ORACLE,
}
