"""Quality measures of retrieval and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_and_mrr(results: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Mean recall at each k and mean reciprocal rank over the queries of ``expected`` (``query_id, id``)."""
    hits = expected.join(results.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    each = hits.groupBy("query_id").agg(*[(F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias(f"recall_{k}") for k in ks], F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("mrr"))
    return each.agg(*[F.avg(f"recall_{k}").alias(f"recall_{k}") for k in ks], F.avg("mrr").alias("mrr"))


def pair_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """``precision, recall`` over pairs of one cluster (``id, cluster``) against pairs of one topic (``id, topic``).

    Pairs are counted from group sizes, none is listed.
    """
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = found.join(truth, "id").groupBy("cluster", "topic").agg(F.count(F.lit(1)).alias("n"))
    clusters = both.groupBy("cluster").agg(F.sum("n").alias("n"))
    topics = both.groupBy("topic").agg(F.sum("n").alias("n"))
    one = lambda df, name: df.agg(pairs("n").alias("v")).select(F.lit(name).alias("k"), "v")
    rows = one(both, "shared").union(one(clusters, "clusters")).union(one(topics, "topics"))
    value = lambda k: F.sum(F.when(F.col("k") == k, F.col("v")))
    return rows.agg((value("shared") / value("clusters")).alias("precision"), (value("shared") / value("topics")).alias("recall"))


def confusion(judged: DataFrame) -> DataFrame:
    """``expected, actual, n`` of a table with these two labels."""
    return judged.groupBy("expected", "actual").agg(F.count(F.lit(1)).alias("n"))


def mean_top(results: DataFrame, k: int) -> DataFrame:
    """Mean score of the first ``k`` results of each query."""
    return results.where(F.col("rank") <= k).groupBy("query_id").agg(F.avg("score").alias("mean_score"))
