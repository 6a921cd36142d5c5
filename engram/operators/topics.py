"""Topics from mutual neighbours, and reports by topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import snippet
from engram.operators.components import connected_components
from engram.operators.knn import mutual, neighbours
from engram.operators.scope import consolidation_active

TOP_K = 5
COSINE = 0.70
SMALL_BOUNDARY = 3
LABEL_SAMPLE = 5


def topics(memories: DataFrame, vectors: DataFrame, k: int = TOP_K, floor: float = COSINE) -> DataFrame:
    """``boundary, topic_id, label, id``: components of the mutual-neighbour graph, single facts kept.

    Topics are numbered by their least fact; a boundary of fewer than ``SMALL_BOUNDARY``
    facts is one topic, ``general``.
    """
    facts = memories.where(consolidation_active()).select("id", "boundary").join(vectors.select("id", "embedding"), "id")
    links = mutual(neighbours(facts, k, floor)).select("a", "b")
    labels = connected_components(links, "topics")
    rooted = facts.select("id", "boundary").join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", "boundary", F.coalesce("label", "id").alias("root"))
    sizes = rooted.groupBy("boundary").agg(F.count(F.lit(1)).alias("facts"))
    rooted = rooted.join(sizes, "boundary")
    small = F.col("facts") < SMALL_BOUNDARY
    roots = rooted.where(~small).select("boundary", "root").distinct()
    numbered = roots.withColumn("topic_id", F.row_number().over(Window.partitionBy("boundary").orderBy("root")) - 1)
    joined = rooted.join(numbered, ["boundary", "root"], "left")
    topic = F.when(small, F.lit(0)).otherwise(F.col("topic_id"))
    return joined.select("boundary", topic.alias("topic_id"), F.when(small, "general").otherwise(F.concat(F.lit("topic_"), topic.cast("string"))).alias("label"), "id")


def label_samples(topics_: DataFrame, memories: DataFrame, most: int = LABEL_SAMPLE) -> DataFrame:
    """The first facts of each topic, as a labelling model reads them."""
    w = Window.partitionBy("boundary", "topic_id").orderBy("id")
    some = topics_.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= most)
    return some.join(memories.select("id", "content"), "id").groupBy("boundary", "topic_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"]).alias("sample"))


def report_rows(topics_: DataFrame, memories: DataFrame, generated_at: Column) -> DataFrame:
    """``boundary, topic, position, id, content, generated_at``: the facts of each report.

    Of topics with one label only the last one's facts stay.
    """
    last = topics_.groupBy("boundary", "label").agg(F.max("topic_id").alias("topic_id"))
    kept = topics_.join(last, ["boundary", "label", "topic_id"], "left_semi").join(memories.select("id", "content"), "id")
    w = Window.partitionBy("boundary", "label").orderBy("id")
    return kept.select("boundary", F.col("label").alias("topic"), F.row_number().over(w).alias("position"), "id", "content", generated_at.alias("generated_at"))


def reports(rows: DataFrame) -> DataFrame:
    """One row a boundary: topics in order of their names with their facts in order."""
    facts = rows.groupBy("boundary", "generated_at", "topic").agg(F.sort_array(F.collect_list(F.struct("position", "id", "content"))).alias("facts"))
    return facts.groupBy("boundary", "generated_at").agg(F.sort_array(F.collect_list(F.struct("topic", "facts"))).alias("topics"))


def markdown(boundary_counts: list, processed: int, seconds: int, date: str) -> str:
    """A short run summary. ``boundary_counts``: rows of ``run_counts``, a few a boundary."""
    lines = [f"# Consolidation run {date}", "", f"Facts processed: {processed}", f"Seconds: {seconds}", ""]
    for r in sorted(boundary_counts, key=lambda r: r.boundary):
        lines += [f"## {r.boundary}", "", f"- superseded: {r.superseded}", f"- invalidated: {r.invalidated}", f"- decayed: {r.decayed}", f"- archived: {r.archived}", ""]
    return "\n".join(lines)


def snippets(memories: DataFrame) -> DataFrame:
    return memories.select("id", snippet(F.col("content")).alias("snippet"))
