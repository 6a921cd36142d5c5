"""The consolidation batch: clusters, duplicates, merges, contradictions, decay, archive, checkpoints.

Every step takes the state it works on and returns a plan or the next state; ``now`` and
``since`` are arguments. Decisions of a language model come in as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.clock import as_rfc3339, expired, idle_for, rfc3339
from engram.functions.jsons import metadata, with_key
from engram.functions.text import containment, words
from engram.functions.vector import changes, decayed, dot
from engram.operators.components import connected_components
from engram.operators.knn import edges, neighbours
from engram.operators.scope import consolidation_active, listed
from engram.sources.shared import materialise

TOP_K = 5
MERGE_COSINE = 0.84
SAME_COSINE = 0.93
SAME_WORDS = 0.80
CONTRADICTION_K = 3
CONTRADICTION_COSINE = 0.70
PAIRWISE_MEMBERS = 20
#: Texts of a cluster that one task compares with as many others; both blocks are in its memory.
TEXTS_IN_BLOCK = 1_000
#: How far from 1 a squared norm may be that counts as 1; the bound on angles gives way by as much.
UNIT_SLACK = 1e-4
DECAY_DAYS = 180
ARCHIVE_DAYS = 365


def clusters(memories: DataFrame, vectors: DataFrame, since: Column | None = None, k: int = TOP_K, floor: float = MERGE_COSINE) -> DataFrame:
    """``boundary, cluster_id, id``: groups of two or more active facts joined by neighbour links.

    Seeds are active facts created at or after ``since`` (all without it). A seed's ``k``
    nearest stored vectors are taken first and those of facts that are not active dropped
    after, so dropped ones use up places. ``cluster_id`` is the least id of the group.
    """
    active = memories.where(consolidation_active()).select("id", "boundary", "created_at")
    seeds = active if since is None else active.where(F.col("created_at") >= since)
    known = active.select("id")
    stored = vectors.select("id", "embedding", "boundary")
    found = neighbours(stored, k, floor, seeds.select("id")).join(known.withColumnRenamed("id", "other"), "other", "left_semi")
    labels = connected_components(edges(found).select("a", "b"), "clusters")
    return labels.select(F.col("node").alias("id"), F.col("label").alias("cluster_id")).join(active.select("id", "boundary"), "id").select("boundary", "cluster_id", "id")


def _holds(good: Column) -> Column:
    """The aggregate of a test over pairs; a pair that cannot be judged says nothing."""
    return F.coalesce(F.bool_and(good), F.lit(True))


def all_same(facts: DataFrame, cosine: float, lexical: float) -> DataFrame:
    """``cluster_id`` of the clusters (``cluster_id, id, said, embedding``) of two or more facts in which every pair is the same fact.

    Copies of one text with one vector are one row with a count: a pair of copies is judged
    once. Texts that are reorderings of each other meet under their sorted words. Then every
    distinct text is held against one centre of its cluster, which ends most clusters that
    fail. Two texts near enough to the centre need no look at each other: with unit vectors
    their angle is at most the sum of their angles to it, and they share at least the centre's
    words less those that either lacks. Only other texts of clusters that passed so far are
    compared pair by pair, a block of texts with a block, so no key gathers a cluster.
    """
    copies = facts.groupBy("cluster_id", "said", "embedding").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    copies = materialise(copies.withColumn("norm", dot(F.col("embedding"), F.col("embedding"))), "cluster-texts")
    # Two copies share all their words unless there are none.
    own = (F.col("n") == 1) | ((F.col("norm") >= cosine) & ((F.size("said") > 0) | F.lit(lexical <= 0)))
    mixed = copies.groupBy("cluster_id", F.array_sort("said").alias("bag")).agg(F.min("said").alias("low"), F.max("said").alias("high"), F.sum("n").alias("n"), _holds(own).alias("own"), F.min("id").alias("id"))
    alone = mixed.groupBy("cluster_id").agg(F.sum("n").alias("facts"), F.bool_and(F.col("own") & (F.col("low") == F.col("high"))).alias("ok"), F.min("id").alias("centre"))
    begun = alone.where(F.col("ok") & (F.col("facts") > 1)).select("cluster_id", "centre")

    centre = begun.join(copies.select(F.col("id").alias("centre"), F.col("said").alias("c_said"), F.col("embedding").alias("c_embedding"), F.col("norm").alias("c_norm")), "centre")
    star = copies.join(centre, "cluster_id")
    cosine_to, share = dot(F.col("embedding"), F.col("c_embedding")), containment(F.col("said"), F.col("c_said"))
    fits = (F.col("id") == F.col("centre")) | ((cosine_to >= cosine) & (share >= lexical))
    # Both bounds hold for any two texts whose own figures allow half of what is left to lose.
    unit = (F.abs(F.col("norm") - 1) < UNIT_SLACK) & (F.abs(F.col("c_norm") - 1) < UNIT_SLACK)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine_to - UNIT_SLACK)))
    distinct = lambda c: F.size(F.array_distinct(c))
    lacks = distinct(F.col("c_said")) - F.size(F.array_intersect("said", "c_said"))
    close = unit & (2 * angle <= F.acos(F.lit(min(1.0, max(-1.0, cosine + 2 * UNIT_SLACK))))) & (distinct(F.col("c_said")) - 2 * lacks >= lexical * distinct(F.col("said")) + 1e-9) & (F.size("said") > 0)
    judged = materialise(star.select("cluster_id", "id", "said", "embedding", fits.alias("fits"), F.coalesce(close, F.lit(False)).alias("close")), "cluster-star")
    passed = judged.groupBy("cluster_id").agg(_holds(F.col("fits")).alias("ok"), F.count_if(~F.col("close")).alias("far"), F.count(F.lit(1)).alias("texts")).where("ok")

    # Each text that is far is held against every text of its cluster, in blocks.
    open_ = passed.where(F.col("far") > 0).withColumn("blocks", F.ceil(F.col("texts") / TEXTS_IN_BLOCK))
    dealt = judged.join(open_.select("cluster_id", "blocks"), "cluster_id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    left = dealt.where(~F.col("close")).select("cluster_id", "block", F.explode(every).alias("other"), F.col("id").alias("a_id"), F.col("said").alias("a_said"), F.col("embedding").alias("a_embedding"))
    right = dealt.select("cluster_id", F.col("block").alias("other"), F.explode(every).alias("block"), F.col("id").alias("b_id"), F.col("close").alias("b_close"), F.col("said").alias("b_said"), F.col("embedding").alias("b_embedding"))
    # Two far texts meet twice, once from either side.
    met = left.join(right, ["cluster_id", "block", "other"]).where((F.col("a_id") < F.col("b_id")) | (F.col("b_close") & (F.col("a_id") != F.col("b_id"))))
    differ = ~((dot(F.col("a_embedding"), F.col("b_embedding")) >= cosine) & (containment(F.col("a_said"), F.col("b_said")) >= lexical))
    failed = met.where(differ).select("cluster_id").distinct()
    return passed.select("cluster_id").join(failed, "cluster_id", "left_anti")


def dedup_plan(members: DataFrame, memories: DataFrame, vectors: DataFrame, cosine: float = SAME_COSINE, lexical: float = SAME_WORDS) -> DataFrame:
    """``cluster_id, survivor, id, access_count, confidence``: clusters in which every pair is the same fact.

    A pair is the same if its dot product and its word containment reach their floors and
    it is no mere reordering (see ``all_same``). One failing pair leaves the whole cluster out. The survivor is
    the latest by validity, then creation, then the longest in bytes, the most confident,
    the most used, and the least id.
    """
    facts = members.join(memories.drop("boundary"), "id").join(vectors.select("id", "embedding"), "id").withColumn("said", words(F.col("content")))
    good = all_same(facts.select("cluster_id", "id", "said", "embedding"), cosine, lexical)
    order = [F.col("valid_from").desc(), F.col("created_at").desc(), F.octet_length("content").desc(), F.col("confidence").desc(), F.col("access_count").desc(), F.col("id")]
    w = Window.partitionBy("cluster_id").orderBy(*order)
    whole = Window.partitionBy("cluster_id")
    kept = facts.join(good, "cluster_id", "left_semi").withColumn("turn", F.row_number().over(w))
    return kept.select(
        "cluster_id",
        F.max(F.when(F.col("turn") == 1, F.col("id"))).over(whole).alias("survivor"),
        "id",
        F.sum("access_count").over(whole).alias("access_count"),
        F.max("confidence").over(whole).alias("confidence"),
    )


def apply_dedup(memories: DataFrame, plan: DataFrame) -> DataFrame:
    """Losers point to their survivor, which takes the summed uses and the highest confidence."""
    p = plan.select("id", "survivor", F.col("access_count").alias("_uses"), F.col("confidence").alias("_conf"))
    joined = memories.join(p, "id", "left")
    survives = F.col("survivor") == F.col("id")
    new = {
        "superseded_by": F.when(F.col("survivor").isNotNull() & ~survives, F.col("survivor")).otherwise(F.col("superseded_by")),
        "access_count": F.when(survives, F.col("_uses")).otherwise(F.col("access_count")),
        "confidence": F.when(survives, F.col("_conf")).otherwise(F.col("confidence")),
    }
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in memories.columns])


def apply_merges(memories: DataFrame, members: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Merged facts join the table and their members point to them.

    ``decisions``: ``cluster_id, decision, new_id, merged_text``; only ``merge`` acts. The new
    fact has the type and scope of the least id, the highest confidence and all uses.
    """
    chosen = members.select("cluster_id", "id").join(decisions.where(F.col("decision") == "merge"), "cluster_id")
    facts = chosen.join(memories, "id")
    first = lambda c: F.min_by(c, "id").alias(c)
    made = facts.groupBy("cluster_id", "new_id", "merged_text").agg(first("memory_type"), first("boundary"), F.max("confidence").alias("confidence"), F.sum("access_count").alias("access_count"))
    nothing = F.lit(None)
    fill = {"id": F.col("new_id"), "content": F.col("merged_text"), "source_agent": nothing, "created_at": now, "valid_from": now, "valid_until": nothing, "last_accessed": now, "superseded_by": nothing, "archived_at": nothing, "metadata_json": F.lit("{}")}
    new = made.select(*[fill.get(c, F.col(c)).cast(memories.schema[c].dataType).alias(c) for c in memories.columns])
    old = memories.join(chosen.select("id", "new_id"), "id", "left").withColumn("superseded_by", F.coalesce("new_id", "superseded_by")).select(*memories.columns)
    return old.unionByName(new)


def contradiction_pairs(memories: DataFrame, vectors: DataFrame, since: Column | None = None, k: int = CONTRADICTION_K, floor: float = CONTRADICTION_COSINE) -> DataFrame:
    """``boundary, a, b``: pairs to hold against each other.

    A full sweep searches among active facts alone. An incremental one searches all stored
    vectors for the new facts' neighbours and drops those that are not active afterwards.
    """
    active = memories.where(consolidation_active()).select("id", "created_at")
    stored = vectors.select("id", "embedding", "boundary")
    if since is None:
        return edges(neighbours(stored.join(active.select("id"), "id", "left_semi"), k, floor))
    seeds = active.where(F.col("created_at") >= since).select("id")
    return edges(neighbours(stored, k, floor, seeds).join(active.select(F.col("id").alias("other")), "other", "left_semi"))


def judge_by_recency(pairs: DataFrame, verdicts: DataFrame, memories: DataFrame) -> DataFrame:
    """``boundary, a, b, stale``: accepted contradictions; the older side is stale, none on a tie.

    ``verdicts``: ``a, b, contradiction, shared_attribute``. What a model says about the
    stale side is not read. A pair without a verdict is skipped.
    """
    accepted = pairs.join(verdicts.where(F.col("contradiction") & F.col("shared_attribute").isNotNull()), ["a", "b"])
    start = memories.select("id", "valid_from")
    joined = accepted.join(start.select(F.col("id").alias("a"), F.col("valid_from").alias("from_a")), "a").join(start.select(F.col("id").alias("b"), F.col("valid_from").alias("from_b")), "b")
    stale = F.when(F.col("from_a") < F.col("from_b"), F.col("a")).when(F.col("from_a") > F.col("from_b"), F.col("b"))
    return joined.select("boundary", "a", "b", stale.alias("stale"))


def group_pairs(groups: DataFrame, most: int = PAIRWISE_MEMBERS) -> tuple[DataFrame, DataFrame]:
    """All pairs of the groups (``group_id, id``) of at most ``most`` members, and the rows of the larger groups."""
    size = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
    small = groups.join(size.where(F.col("members") <= most).select("group_id"), "group_id", "left_semi")
    pairs = small.select("group_id", F.col("id").alias("a")).join(small.select("group_id", F.col("id").alias("b")), "group_id").where("a < b")
    return pairs, groups.join(size.where(F.col("members") > most).select("group_id"), "group_id", "left_semi").select("group_id", "id")


def guarded(stale: DataFrame, groups: DataFrame) -> DataFrame:
    """``group_id, id, refused``: verdict ids that belong to their group, once each.

    A verdict that would invalidate a whole group is refused.
    """
    hit = stale.select("group_id", "id").distinct().join(groups.select("group_id", "id"), ["group_id", "id"], "left_semi")
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
    hits = hit.groupBy("group_id").agg(F.count(F.lit(1)).alias("hits"))
    return hit.join(sizes, "group_id").join(hits, "group_id").select("group_id", "id", (F.col("hits") >= F.col("members")).alias("refused"))


def invalidate(memories: DataFrame, ids: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Facts whose validity ends at ``at``, and the ids refused because they begin later."""
    joined = memories.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    ok = F.col("_hit").isNotNull() & (F.col("valid_from") <= at)
    refused = joined.where(F.col("_hit").isNotNull() & (F.col("valid_from") > at)).select("id")
    return joined.withColumn("valid_until", F.when(ok, at).otherwise(F.col("valid_until"))).select(*memories.columns), refused


def mark_superseded(memories: DataFrame, links: DataFrame) -> DataFrame:
    """``links``: ``id, by``. An older mark is overwritten, so chains can form."""
    return memories.join(links.select("id", "by"), "id", "left").withColumn("superseded_by", F.coalesce("by", "superseded_by")).select(*memories.columns)


def decay_plan(memories: DataFrame, now: Column, days: int = DECAY_DAYS) -> DataFrame:
    """``id, old_confidence, new_confidence`` of idle facts that were not decayed within ``days``.

    The marker of the last decay is an RFC 3339 time; one that is missing or malformed counts as none.
    """
    marker = rfc3339(metadata(F.col("metadata_json"), "decay.last_decay_at"))
    due = marker.isNull() | idle_for(marker, now, days)
    lower = decayed(F.col("confidence"))
    idle = F.col("superseded_by").isNull() & ~expired(F.col("valid_until"), now) & idle_for(F.col("last_accessed"), now, days)
    return memories.where(listed() & idle & due & changes(F.col("confidence"), lower)).select("id", F.col("confidence").alias("old_confidence"), lower.alias("new_confidence"))


def apply_decay(memories: DataFrame, plan: DataFrame, now: Column) -> DataFrame:
    """Lower confidence and the marker of this decay; the time of last use stays."""
    joined = memories.join(plan.select("id", "new_confidence"), "id", "left")
    hit = F.col("new_confidence").isNotNull()
    marked = with_key(F.col("metadata_json"), "decay", F.concat(F.lit('{"last_decay_at":"'), as_rfc3339(now), F.lit('"}')))
    new = {"confidence": F.coalesce("new_confidence", "confidence"), "metadata_json": F.when(hit, marked).otherwise(F.col("metadata_json"))}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in memories.columns])


def archive_plan(memories: DataFrame, now: Column, days: int = ARCHIVE_DAYS) -> DataFrame:
    return memories.where(listed() & ~expired(F.col("valid_until"), now) & idle_for(F.col("last_accessed"), now, days)).select("id")


def apply_archive(memories: DataFrame, plan: DataFrame, now: Column) -> DataFrame:
    joined = memories.join(plan.select("id").withColumn("_hit", F.lit(True)), "id", "left")
    return joined.withColumn("archived_at", F.when(F.col("_hit"), now).otherwise(F.col("archived_at"))).select(*memories.columns)


def checkpoint_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``memory_id, boundary, change_type, pre_image``: modified rows with the row before as JSON, and created rows.

    Rows that vanished are ``deleted``; a run never deletes, so they are reported and not restored.
    """
    image = F.to_json(F.struct(*before.columns), {"ignoreNullFields": "false"})
    b = before.select(F.col("id").alias("memory_id"), F.col("boundary").alias("b_boundary"), image.alias("pre_image"), F.struct(*[F.col(c) for c in before.columns if c != "id"]).alias("b"))
    a = after.select(F.col("id").alias("memory_id"), F.col("boundary").alias("a_boundary"), F.struct(*[F.col(c) for c in before.columns if c != "id"]).alias("a"))
    both = b.join(a, "memory_id", "full")
    kind = F.when(F.col("b").isNull(), "created").when(F.col("a").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return both.withColumn("change_type", kind).where(F.col("change_type").isNotNull()).select(
        "memory_id", F.coalesce("a_boundary", "b_boundary").alias("boundary"), "change_type", F.when(F.col("change_type") == "modified", F.col("pre_image")).alias("pre_image")
    )


def create_checkpoint(entries: DataFrame, checkpoint_id: str) -> DataFrame:
    """Entries under a checkpoint id; an empty checkpoint is an error."""
    kept = entries.where(F.col("change_type") != "deleted")
    if kept.isEmpty():
        raise ValueError("nothing changed, no checkpoint to create")
    return kept.withColumn("checkpoint_id", F.lit(checkpoint_id))


def rollback(memories: DataFrame, entries: DataFrame) -> DataFrame:
    """The table with modified rows as they were and created rows gone."""
    old = entries.where(F.col("change_type") == "modified").select(F.from_json("pre_image", memories.schema).alias("r")).select("r.*")
    rest = memories.join(entries.select(F.col("memory_id").alias("id")), "id", "left_anti")
    return rest.unionByName(old.select(*memories.columns))


def run_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per boundary: facts processed, superseded, invalidated, decayed and archived by a run."""
    b = before.select("id", *[F.col(c).alias(f"b_{c}") for c in ("superseded_by", "valid_until", "confidence", "archived_at")])
    j = after.join(b, "id", "left")
    fresh = lambda c: F.count_if(F.col(c).isNotNull() & F.col(f"b_{c}").isNull())
    return j.groupBy("boundary").agg(
        F.count("b_confidence").alias("processed"), fresh("superseded_by").alias("superseded"), fresh("valid_until").alias("invalidated"),
        F.count_if(F.col("confidence") < F.col("b_confidence")).alias("decayed"), fresh("archived_at").alias("archived"),
    )
