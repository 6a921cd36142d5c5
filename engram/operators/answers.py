"""Answers of language models: asked once, kept, and read under a checked form.

A model is asked once per distinct prompt. Answers are appended to a folder in shared
storage under the fingerprint of their prompt, so a run that is lost and started again
asks only what has no answer yet. Answers are JSON; one that breaks its form is set apart
with the fault that it has, and never stops a run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import models
from engram.sources.shared import drop, exists, materialise, shared_path

KEPT = "asked string, json string"
#: Bytes of the facts that one prompt may hold; the context of the model bounds it.
PROMPT_BYTES = 262_144

NO_ANSWER, MALFORMED, NO_OBJECT, UNKNOWN, TOO_LONG = "no answer", "malformed", "no object", "unknown decision", "prompt too long"
#: The decisions about a cluster and the texts that each must hold.
DECISIONS = {"merge": ("reasoning", "merged_text"), "keep_separate": ("reasoning",), "contradiction": ("reasoning",)}
#: Fixed value: the text that a contradiction may hold or leave null.
WINNER = "clear_winner"


def ask(prompts: DataFrame, make: Callable[[], models.Judge], folder: str | None = None, blocks: int = 1) -> DataFrame:
    """``prompts`` with the model's ``json`` in place of their ``prompt``; null where it gave none or there is no prompt.

    ``folder`` keeps the answers of all runs (a fresh one without it). New prompts are asked
    in ``blocks`` jobs, each of which keeps its answers before the next begins. What the model
    did not answer is not kept, so it is asked again next time.
    """
    spark = prompts.sparkSession
    folder = folder or shared_path(spark, "answers")
    keyed = prompts.withColumn("_asked", F.sha2("prompt", 256))
    fresh = keyed.where(F.col("prompt").isNotNull()).groupBy(F.col("_asked").alias("asked")).agg(F.first("prompt").alias("prompt"))
    fresh = materialise(fresh.join(kept(spark, folder).select("asked"), "asked", "left_anti"), "prompts")
    for block in range(blocks):
        mine = fresh.where(F.pmod(F.xxhash64("asked"), F.lit(blocks)) == block)
        told = mine.select("asked", models.judge(F.col("prompt"), make).alias("json")).where(F.col("json").isNotNull())
        told.write.mode("append").option("compression", "zstd").parquet(folder)
    drop(fresh)
    # Two runs at once may both have asked; one answer of a prompt counts, the same for all readers.
    one = kept(spark, folder).groupBy("asked").agg(F.min("json").alias("json"))
    return keyed.drop("prompt").join(one.withColumnRenamed("asked", "_asked"), "_asked", "left").drop("_asked")


def kept(spark: SparkSession, folder: str) -> DataFrame:
    """``asked, json``: the answers in ``folder``; none where there is no such folder."""
    return spark.read.schema(KEPT).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], KEPT)


def parsed(json: Column) -> Column:
    """The answer as a variant; null for text that is not exactly one JSON value.

    The parser reads one value and leaves what follows, so the text is read as the first of two
    members. A key that an object holds twice makes it malformed.
    """
    pair = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), json, F.lit(",0]"))), "$", "array<variant>")
    return F.when(F.size(pair) == 2, F.element_at(pair, 1))


def kind(value: Column, path: str = "$") -> Column:
    """``STRING``, ``BIGINT``, ``VOID`` (a JSON null) and so on; null where there is nothing at ``path``."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def text(value: Column, path: str = "$") -> Column:
    """The string at ``path``; null where there is none or a value of another kind."""
    return F.when(kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def items(value: Column, path: str) -> Column:
    """The array at ``path`` as variants; empty where there is none or a value of another kind."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))


def object_fault(json: Column, value: Column) -> Column:
    """Why ``json``, read as ``value``, is no object; null if it is one."""
    return F.when(json.isNull(), NO_ANSWER).when(value.isNull(), MALFORMED).when(~F.startswith(kind(value), F.lit("OBJECT")), NO_OBJECT)


def merge_decisions(answers: DataFrame) -> DataFrame:
    """``answers`` (with a column ``json``) with ``fault, decision, merged_text, reasoning, winner``.

    ``decision`` says which texts an answer must hold; ``clear_winner`` of a contradiction is a
    text, null or missing. Keys besides these are not looked at. A faulty answer has no
    decision: ``no answer``, ``malformed``, ``no object``, ``unknown decision``, or ``no text:``
    with the first key that breaks the form.
    """
    rows = answers.withColumn("_v", parsed(F.col("json")))
    v = F.col("_v")
    said = text(v, "$.decision")
    fault = F.coalesce(object_fault(F.col("json"), v), F.when(~F.coalesce(said.isin(*DECISIONS), F.lit(False)), UNKNOWN))
    for name in sorted({f for fields in DECISIONS.values() for f in fields}):
        needed = said.isin(*[d for d, fields in DECISIONS.items() if name in fields])
        fault = F.coalesce(fault, F.when(needed & text(v, f"$.{name}").isNull(), f"no text: {name}"))
    wrong = ~F.coalesce(kind(v, f"$.{WINNER}"), F.lit("VOID")).isin("STRING", "VOID")
    rows = rows.withColumn("fault", F.coalesce(fault, F.when((said == "contradiction") & wrong, f"no text: {WINNER}")))
    good = F.col("fault").isNull()
    return rows.withColumns({
        "decision": F.when(good, said),
        "merged_text": F.when(good & (said == "merge"), text(v, "$.merged_text")),
        "reasoning": F.when(good, text(v, "$.reasoning")),
        "winner": F.when(good & (said == "contradiction"), text(v, f"$.{WINNER}")),
    }).drop("_v")


def merge_prompts(members: DataFrame, memories: DataFrame, most: int = PROMPT_BYTES) -> DataFrame:
    """``cluster_id, prompt, fault``: the facts of each cluster as JSON, by id.

    Contents are summed before any are gathered: a cluster of more than ``most`` bytes gets no
    prompt and the fault ``prompt too long``, as no model could read it. One of which a fact is
    gone gets ``missing fact``.
    """
    facts = members.select("cluster_id", "id").join(memories.select("id", "content"), "id", "left")
    size = facts.groupBy("cluster_id").agg(F.sum(F.octet_length("content") + F.octet_length("id")).alias("bytes"), F.count_if(F.col("content").isNull()).alias("gone"))
    fault = F.when(F.col("gone") > 0, "missing fact").when(F.col("bytes") > most, TOO_LONG)
    judged = size.select("cluster_id", fault.alias("fault"))
    fits = facts.join(judged.where(F.col("fault").isNull()).select("cluster_id"), "cluster_id", "left_semi")
    body = F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("id", "content"))).alias("memories")))
    return judged.join(fits.groupBy("cluster_id").agg(body.alias("prompt")), "cluster_id", "left").select("cluster_id", "prompt", "fault")


def decide_merges(members: DataFrame, memories: DataFrame, make: Callable[[], models.Judge], folder: str | None = None, blocks: int = 1, most: int = PROMPT_BYTES) -> DataFrame:
    """``cluster_id, fault, decision, new_id, merged_text, reasoning, winner`` of every cluster, from prompt to decision.

    Rows without a fault are what ``consolidation_run`` takes as ``decisions``; the others are
    skipped and tried again by the next run. ``new_id`` follows from the cluster and the text,
    so a run that is repeated makes the same fact.
    """
    told = ask(merge_prompts(members, memories, most).withColumnRenamed("fault", "_early"), make, folder, blocks)
    read = merge_decisions(told).withColumn("fault", F.coalesce("_early", "fault"))
    new_id = F.concat(F.lit("m"), F.substring(F.sha2(F.concat_ws("\x1f", "cluster_id", "merged_text"), 256), 1, 32))
    return read.select("cluster_id", "fault", "decision", F.when(F.col("merged_text").isNotNull(), new_id).alias("new_id"), "merged_text", "reasoning", "winner")


def fault_counts(decided: DataFrame) -> DataFrame:
    """``fault, clusters``: how many answers were skipped, and why."""
    return decided.where(F.col("fault").isNotNull()).groupBy("fault").agg(F.count(F.lit(1)).alias("clusters"))
