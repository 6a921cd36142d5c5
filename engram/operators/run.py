"""One whole consolidation run, phase by phase on a state that each phase reads anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators import consolidate as C
from engram.sources.shared import materialise


@dataclass(frozen=True)
class RunResult:
    """``state``: facts after the run. ``entries``: what changed. ``review``: conflicts without a winner."""

    state: DataFrame
    entries: DataFrame
    review: DataFrame
    counts: DataFrame


def _winner_takes(state: DataFrame, members: DataFrame, decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Contradictions inside a cluster: with a winner the others end now, without one they go to review."""
    conflicts = members.select("cluster_id", "id").join(decisions.where(F.col("decision") == "contradiction").select("cluster_id", "winner"), "cluster_id")
    losers = conflicts.where(F.col("winner").isNotNull() & (F.col("id") != F.col("winner"))).select("id")
    review = conflicts.where(F.col("winner").isNull()).groupBy("cluster_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return C.invalidate(state, losers, now)[0], review


def consolidation_run(
    memories: DataFrame,
    vectors: DataFrame,
    now: Column,
    since: Column | None = None,
    decisions: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    group_verdicts: DataFrame | None = None,
    merge_cosine: float = C.MERGE_COSINE,
    contradiction_cosine: float = C.CONTRADICTION_COSINE,
) -> RunResult:
    """Duplicates, merges, contradictions, decay, archive, in this order.

    ``decisions`` (``cluster_id, decision, new_id, merged_text, winner``) and ``verdicts``
    (``a, b, contradiction, shared_attribute``) are the answers of language models; a cluster
    or pair without one is left alone. ``group_verdicts`` (``cluster_id, id``) name the stale
    facts of clusters that were judged as a whole; a verdict against all of a cluster is
    refused. No phase deletes a fact.
    """
    members = materialise(C.clusters(memories, vectors, since, floor=merge_cosine), "run-clusters")
    plan = materialise(C.dedup_plan(members, memories, vectors), "run-plan")
    state = materialise(C.apply_dedup(memories, plan), "run-state")
    review = members.limit(0).groupBy("cluster_id").agg(F.collect_list("id").alias("ids"))
    if decisions is not None:
        rest = members.join(plan.select("cluster_id").distinct(), "cluster_id", "left_anti")
        state = C.apply_merges(state, rest, decisions, now)
        state, review = _winner_takes(state, rest, decisions, now)
        state = materialise(state, "run-state")
    if verdicts is not None:
        pairs = C.contradiction_pairs(state, vectors, since, floor=contradiction_cosine)
        stale = C.judge_by_recency(pairs, verdicts, state).where(F.col("stale").isNotNull()).select(F.col("stale").alias("id"))
        state = materialise(C.invalidate(state, stale, now)[0], "run-state")
    if group_verdicts is not None:
        groups = members.select(F.col("cluster_id").alias("group_id"), "id")
        named = C.guarded(group_verdicts.select(F.col("cluster_id").alias("group_id"), "id"), groups)
        state = materialise(C.invalidate(state, named.where(~F.col("refused")).select("id"), now)[0], "run-state")
    state = materialise(C.apply_decay(state, C.decay_plan(state, now), now), "run-state")
    state = materialise(C.apply_archive(state, C.archive_plan(state, now), now), "run-state")
    return RunResult(state, C.checkpoint_diff(memories, state), review, C.run_counts(memories, state))
