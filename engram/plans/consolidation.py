"""The consolidation batch over the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions.clock import rfc3339
from engram.operators import consolidate, evaluate, topics
from engram.plans import sql as S
from engram.plans.register import Register
from engram.sources import views
from engram.sources.views import DAY, NOW

REGISTER = Register()
FLOOR = 0.30
seconds = F.unix_seconds

_CLUSTERS = f"""{S.MEMORIES}, {S.VECTORS}, active AS (SELECT * FROM memories WHERE {S.ACTIVE}), {S.neighbours(5, FLOOR)},
link AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM near WHERE id IN (SELECT id FROM active) AND other IN (SELECT id FROM active)),
{S.components('link')}, members AS (SELECT m.boundary, root AS cluster_id, id FROM comp JOIN active m USING (id))"""


def _clusters(spark, d, since=None):
    return consolidate.clusters(views.memories(spark, d), views.vectors(spark, d), since, floor=FLOOR)


@REGISTER(f"WITH RECURSIVE {_CLUSTERS} SELECT * FROM members")
def clusters(spark, d):
    return _clusters(spark, d)


@REGISTER(
    f"WITH RECURSIVE {_CLUSTERS.replace('WHERE id IN (SELECT id FROM active)', 'WHERE id IN (SELECT id FROM active WHERE n >= 100)')} SELECT * FROM members"
)
def clusters_incremental(spark, d):
    """Seeds are the facts created since the watermark; they match against all."""
    return _clusters(spark, d, views.at(views.EPOCH + 6000))


_DEDUP = f"""facts AS (SELECT x.cluster_id, m.*, v.e, {S.words('content')} AS w FROM members x JOIN memories m USING (id) JOIN vectors v USING (id)),
verdict AS (SELECT a.cluster_id, bool_and(list_dot_product(a.e, b.e) >= 0.3 AND CAST(len(list_intersect(list_distinct(a.w), list_distinct(b.w))) AS DOUBLE) / greatest(least(len(list_distinct(a.w)), len(list_distinct(b.w))), 1) >= 0.05
  AND NOT (a.w <> b.w AND list_sort(a.w) = list_sort(b.w))) AS ok FROM facts a JOIN facts b ON a.cluster_id = b.cluster_id AND a.id < b.id GROUP BY a.cluster_id),
turns AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY starts DESC, created DESC, strlen(content) DESC, confidence DESC, uses DESC, id) AS turn FROM facts JOIN verdict USING (cluster_id) WHERE ok),
plan AS (SELECT cluster_id, max(CASE WHEN turn = 1 THEN id END) OVER (PARTITION BY cluster_id) AS survivor, id, CAST(sum(uses) OVER (PARTITION BY cluster_id) AS BIGINT) AS uses, max(confidence) OVER (PARTITION BY cluster_id) AS confidence FROM turns)"""


def _plan(spark, d):
    return consolidate.dedup_plan(_clusters(spark, d), views.memories(spark, d), views.vectors(spark, d), 0.3, 0.05)


@REGISTER(f"WITH RECURSIVE {_CLUSTERS}, {_DEDUP} SELECT cluster_id, survivor, id, uses, round(CAST(confidence AS DOUBLE), 4) AS confidence FROM plan")
def dedup_plan(spark, d):
    return _plan(spark, d).select("cluster_id", "survivor", "id", F.col("access_count").alias("uses"), F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


@REGISTER(
    f"""WITH RECURSIVE {_CLUSTERS}, {_DEDUP} SELECT m.id, CASE WHEN p.survivor <> m.id THEN p.survivor ELSE m.superseded_by END AS superseded_by,
CASE WHEN p.survivor = m.id THEN p.uses ELSE m.uses END AS uses, round(CAST(CASE WHEN p.survivor = m.id THEN p.confidence ELSE m.confidence END AS DOUBLE), 4) AS confidence FROM memories m LEFT JOIN plan p ON p.id = m.id"""
)
def dedup_applied(spark, d):
    made = consolidate.apply_dedup(views.memories(spark, d), _plan(spark, d))
    return made.select("id", "superseded_by", F.col("access_count").alias("uses"), F.round(F.col("confidence").cast("double"), 4).alias("confidence"))


@REGISTER(
    f"""WITH RECURSIVE {_CLUSTERS}, chosen AS (SELECT * FROM members WHERE CAST(cluster_id AS BIGINT) % 2 = 0),
made AS (SELECT 'm' || cluster_id AS id, arg_min(m.memory_type, m.id) AS memory_type, arg_min(m.boundary, m.id) AS boundary, max(confidence) AS confidence, CAST(sum(uses) AS BIGINT) AS uses, NULL AS superseded_by FROM chosen JOIN memories m USING (id) GROUP BY cluster_id)
SELECT m.id, memory_type, m.boundary, round(CAST(confidence AS DOUBLE), 4) AS confidence, uses, CASE WHEN c.id IS NOT NULL THEN 'm' || cluster_id ELSE superseded_by END AS superseded_by FROM memories m LEFT JOIN chosen c ON c.id = m.id
UNION ALL SELECT id, memory_type, boundary, round(CAST(confidence AS DOUBLE), 4), uses, superseded_by FROM made"""
)
def merges_applied(spark, d):
    members = _clusters(spark, d)
    even = F.col("cluster_id").cast("bigint") % 2 == 0
    decisions = members.select("cluster_id").distinct().select("cluster_id", F.when(even, "merge").otherwise("keep_separate").alias("decision"), F.concat(F.lit("m"), "cluster_id").alias("new_id"), F.lit("merged").alias("merged_text"))
    made = consolidate.apply_merges(views.memories(spark, d), members, decisions, views.now())
    return made.select("id", "memory_type", "boundary", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), F.col("access_count").alias("uses"), "superseded_by")


_PAIRS = f"""{S.MEMORIES}, {S.VECTORS}, av AS (SELECT v.* FROM vectors v JOIN memories m ON m.id = v.id WHERE {S.ACTIVE}), {S.neighbours(3, FLOOR, 'near', 'av')},
pair AS (SELECT DISTINCT boundary, least(id, other) AS a, greatest(id, other) AS b FROM near),
judged AS (SELECT p.*, CASE WHEN x.starts < y.starts THEN a WHEN x.starts > y.starts THEN b END AS stale FROM pair p JOIN memories x ON x.id = a JOIN memories y ON y.id = b WHERE (CAST(a AS BIGINT) + CAST(b AS BIGINT)) % 2 = 0)"""


def _judged(spark, d):
    m = views.memories(spark, d)
    pairs = consolidate.contradiction_pairs(m, views.vectors(spark, d), floor=FLOOR)
    s = F.col("a").cast("bigint") + F.col("b").cast("bigint")
    verdicts = pairs.select("a", "b", (s % 2 == 0).alias("contradiction"), F.lit("colour").alias("shared_attribute"))
    return m, pairs, consolidate.judge_by_recency(pairs, verdicts, m)


@REGISTER(f"WITH {_PAIRS} SELECT * FROM pair")
def contradiction_pairs(spark, d):
    return _judged(spark, d)[1]


@REGISTER(f"WITH {_PAIRS} SELECT * FROM judged")
def contradictions_judged(spark, d):
    return _judged(spark, d)[2]


@REGISTER(f"WITH {_PAIRS} SELECT id, CASE WHEN id IN (SELECT stale FROM judged) AND starts <= {NOW} THEN {NOW} ELSE ends END AS ends FROM memories")
def contradictions_applied(spark, d):
    m, _, judged = _judged(spark, d)
    made, _ = consolidate.invalidate(m, judged.where("stale is not null").select(F.col("stale").alias("id")), views.now())
    return made.select("id", seconds("valid_until").alias("ends"))


@REGISTER(
    f"""WITH {S.MEMORIES}, g AS (SELECT n % 40 AS group_id, id, n FROM memories), h AS (SELECT DISTINCT group_id, id FROM g WHERE group_id < 3 OR n % 7 = 0)
SELECT group_id, id, count(*) OVER (PARTITION BY group_id) >= (SELECT count(*) FROM g WHERE g.group_id = h.group_id) AS refused FROM h"""
)
def mass_invalidate_guard(spark, d):
    n = F.col("id").cast("bigint")
    groups = views.memories(spark, d).select((n % 40).alias("group_id"), "id")
    stale = groups.where((F.col("group_id") < 3) | (n % 7 == 0))
    return consolidate.guarded(stale.union(stale).union(groups.where("group_id = 5").select("group_id", F.lit("nobody"))), groups)


def _judge_groups(spark, d):
    """Groups of ten neighbours, and two groups (-1 and -2) that hold a third of all facts; so both kinds exist at every size."""
    n = F.col("id").cast("bigint")
    return views.memories(spark, d).select(F.when(n % 3 == 0, -1 - n % 2).otherwise(F.floor(n / 15)).alias("group_id"), "id")


_GROUPS = f"{S.MEMORIES}, g AS (SELECT CASE WHEN n % 3 = 0 THEN -1 - n % 2 ELSE n // 15 END AS group_id, id FROM memories), z AS (SELECT group_id, count(*) AS c FROM g GROUP BY group_id)"


@REGISTER(f"WITH {_GROUPS} SELECT x.group_id, x.id AS a, y.id AS b FROM g x JOIN g y ON x.group_id = y.group_id AND x.id < y.id JOIN z ON z.group_id = x.group_id WHERE c <= 20")
def pairwise_judge_pairs(spark, d):
    """Pairs of the groups that are judged pair by pair; ``nary_judge_groups`` has the other groups."""
    return consolidate.group_pairs(_judge_groups(spark, d))[0]


@REGISTER(f"WITH {_GROUPS} SELECT group_id, id, 'nary' AS mode FROM g JOIN z USING (group_id) WHERE c > 20")
def nary_judge_groups(spark, d):
    """Members of the groups too large for pairs, which go to one judgement of the whole group."""
    return consolidate.group_pairs(_judge_groups(spark, d))[1].withColumn("mode", F.lit("nary"))


_DECAY = f"""{S.MEMORIES}, decay AS (SELECT id, confidence, CAST(CAST(confidence AS DOUBLE) * CAST(0.9 AS DOUBLE) AS FLOAT) AS lower FROM memories
  WHERE {S.LISTED} AND coalesce(ends > {NOW}, true) AND {NOW} - used >= {180 * DAY} AND (decayed_at IS NULL OR {NOW} - decayed_at >= {180 * DAY})),
archive AS (SELECT id FROM memories WHERE {S.LISTED} AND coalesce(ends > {NOW}, true) AND {NOW} - used >= {365 * DAY})"""


@REGISTER(f"WITH {_DECAY} SELECT id, round(CAST(confidence AS DOUBLE), 4) AS old_confidence, round(CAST(lower AS DOUBLE), 4) AS new_confidence FROM decay")
def decay_plan(spark, d):
    plan = consolidate.decay_plan(views.memories(spark, d), views.now())
    return plan.select("id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("old_confidence", "new_confidence")])


@REGISTER(f"WITH {_DECAY} SELECT * FROM archive")
def archive_plan(spark, d):
    return consolidate.archive_plan(views.memories(spark, d), views.now())


def _aged(spark, d):
    m, now = views.memories(spark, d), views.now()
    after = consolidate.apply_decay(m, consolidate.decay_plan(m, now), now)
    return m, consolidate.apply_archive(after, consolidate.archive_plan(after, now), now)


@REGISTER(f"WITH {_DECAY} SELECT m.id, round(CAST(coalesce(d.lower, m.confidence) AS DOUBLE), 4) AS confidence, CASE WHEN a.id IS NOT NULL THEN {NOW} ELSE archived END AS archived, CASE WHEN d.id IS NOT NULL THEN {NOW} ELSE decayed_at END AS decayed_at FROM memories m LEFT JOIN decay d ON d.id = m.id LEFT JOIN archive a ON a.id = m.id")
def decay_and_archive_applied(spark, d):
    after = _aged(spark, d)[1]
    return after.select("id", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), seconds("archived_at").alias("archived"), seconds(rfc3339(F.get_json_object("metadata_json", "$.decay.last_decay_at"))).alias("decayed_at"))


@REGISTER(f"WITH {_DECAY} SELECT id AS memory_id, boundary, 'modified' AS change_type FROM memories WHERE id IN (SELECT id FROM decay UNION SELECT id FROM archive)")
def checkpoint_entries(spark, d):
    before, after = _aged(spark, d)
    return consolidate.create_checkpoint(consolidate.checkpoint_diff(before, after), "run1").select("memory_id", "boundary", "change_type")


@REGISTER("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM documents")
def rollback_restores(spark, d):
    """Rows after a run and its rollback, and how many of them differ from before the run."""
    before, after = _aged(spark, d)
    back = consolidate.rollback(after, consolidate.checkpoint_diff(before, after))
    left = consolidate.checkpoint_diff(before, back).select(F.lit(0).alias("rows"), F.lit(1).alias("differing"))
    return back.select(F.lit(1).alias("rows"), F.lit(0).alias("differing")).union(left).agg(F.sum("rows").alias("rows"), F.sum("differing").alias("differing"))


@REGISTER(
    f"WITH {_DECAY} SELECT boundary, count(*) AS processed, CAST(0 AS BIGINT) AS superseded, CAST(0 AS BIGINT) AS invalidated, count(d.id) AS decayed, count(a.id) AS archived FROM memories m LEFT JOIN decay d ON d.id = m.id LEFT JOIN archive a ON a.id = m.id GROUP BY boundary"
)
def run_counters(spark, d):
    return consolidate.run_counts(*_aged(spark, d))


_TOPICS = f"""{S.MEMORIES}, {S.VECTORS}, av AS (SELECT v.* EXCLUDE (boundary), m.boundary FROM vectors v JOIN memories m ON m.id = v.id WHERE {S.ACTIVE}), {S.neighbours(5, FLOOR, 'near', 'av')},
link AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM near x WHERE EXISTS (SELECT 1 FROM near y WHERE y.id = x.other AND y.other = x.id)),
{S.components('link')}, rooted AS (SELECT av.boundary, av.id, coalesce(root, av.id) AS root FROM av LEFT JOIN comp ON comp.id = av.id),
topic AS (SELECT boundary, id, dense_rank() OVER (PARTITION BY boundary ORDER BY root) - 1 AS topic_id FROM rooted)"""


def _topics(spark, d):
    return topics.topics(views.memories(spark, d), views.vectors(spark, d), floor=FLOOR)


@REGISTER(f"WITH RECURSIVE {_TOPICS} SELECT boundary, CAST(topic_id AS INTEGER) AS topic_id, 'topic_' || topic_id AS label, id FROM topic")
def topic_discovery(spark, d):
    return _topics(spark, d).withColumn("topic_id", F.col("topic_id").cast("int"))


@REGISTER(f"WITH RECURSIVE {_TOPICS} SELECT boundary, 'topic_' || topic_id AS topic, CAST(row_number() OVER (PARTITION BY boundary, topic_id ORDER BY id) AS INTEGER) AS position, id FROM topic")
def report_rows(spark, d):
    return topics.report_rows(_topics(spark, d), views.memories(spark, d), views.now()).select("boundary", "topic", "position", "id")


@REGISTER(f"WITH RECURSIVE {_TOPICS} SELECT boundary, count(DISTINCT topic_id) AS topics, count(*) AS facts FROM topic GROUP BY boundary")
def reports_nested(spark, d):
    made = topics.reports(topics.report_rows(_topics(spark, d), views.memories(spark, d), views.now()))
    facts = F.aggregate(F.transform("topics", lambda t: F.size(t["facts"])), F.lit(0), lambda s, x: s + x)
    return made.select("boundary", F.size("topics").cast("bigint").alias("topics"), facts.cast("bigint").alias("facts"))


@REGISTER(
    f"""WITH RECURSIVE {_CLUSTERS}, f AS (SELECT cluster_id, label, count(*) AS n FROM members JOIN vectors USING (id) GROUP BY cluster_id, label),
c AS (SELECT cluster_id, sum(n) AS n FROM f GROUP BY cluster_id), l AS (SELECT label, sum(n) AS n FROM f GROUP BY label)
SELECT round((SELECT sum(n * (n - 1) / 2) FROM f) / (SELECT sum(n * (n - 1) / 2) FROM c), 6) AS precision, round((SELECT sum(n * (n - 1) / 2) FROM f) / (SELECT sum(n * (n - 1) / 2) FROM l), 6) AS recall"""
)
def clustering_scores(spark, d):
    truth = views.vectors(spark, d).select("id", F.col("label").alias("topic"))
    made = evaluate.pair_scores(_clusters(spark, d).select("id", F.col("cluster_id").alias("cluster")), truth)
    return made.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
