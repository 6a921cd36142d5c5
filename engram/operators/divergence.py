"""Does the vector table still hold what the fact table holds?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES = 50
WINDOW_DAYS = 30


def count_check(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """``memories, vectors, differ``."""
    both = memories.select(F.lit(1).alias("m"), F.lit(0).alias("v")).union(vectors.select(F.lit(0), F.lit(1)))
    return both.agg(F.sum("m").alias("memories"), F.sum("v").alias("vectors")).withColumn("differ", F.col("memories") != F.col("vectors"))


def sampled_missing(memories: DataFrame, vectors: DataFrame, now: Column, seed: int, samples: int = SAMPLES) -> DataFrame:
    """``id, recent``: sampled facts without a vector, ``samples`` from the last days and from before each.

    The draw is by a seeded hash of the id, which Spark can do as a top-k.
    """
    recent = F.col("created_at") >= now - F.expr(f"interval {WINDOW_DAYS} days")
    known = vectors.select("id")
    drawn = None
    for wanted in (True, False):
        part = memories.where(recent if wanted else ~recent).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(samples).select("id", F.lit(wanted).alias("recent"))
        drawn = part if drawn is None else drawn.unionByName(part)
    return drawn.join(known, "id", "left_anti")


def all_missing(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every fact without a vector and every vector without a fact."""
    no_vector = memories.select("id").join(vectors.select("id"), "id", "left_anti").withColumn("missing_in", F.lit("vectors"))
    return no_vector.unionByName(vectors.select("id").join(memories.select("id"), "id", "left_anti").withColumn("missing_in", F.lit("memories")))
