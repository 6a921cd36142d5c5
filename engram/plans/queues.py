"""Change queue and audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions.jsons import AUDIT_FIELDS
from engram.functions.vector import sigmoid
from engram.operators import audit, outbox
from engram.plans import sql as S
from engram.plans.register import Register
from engram.sources import tables, views
from engram.sources.shared import table
from engram.sources.views import EPOCH

REGISTER = Register()
HALF = EPOCH + 500_000
seconds = F.unix_seconds


@REGISTER(f"WITH {S.OUTBOX} SELECT id, memory_id, operation FROM outbox WHERE due <= {HALF} ORDER BY seq, due LIMIT 100")
def due_entries(spark, d):
    return outbox.due(views.outbox(spark, d), views.at(HALF), 100).select("id", "memory_id", "operation")


_NET = f"{S.OUTBOX}, net AS (SELECT memory_id, max(seq) AS seq, arg_max(operation, seq) AS operation, arg_max(payload, seq) AS payload FROM outbox GROUP BY memory_id)"


@REGISTER(f"WITH {_NET} SELECT memory_id, seq AS sequence_id, operation, payload FROM net")
def net_changes(spark, d):
    return outbox.net_changes(views.outbox(spark, d))


@REGISTER(
    f"""WITH {_NET}, t AS (SELECT {S.KEY.format('c_custkey')} AS memory_id, c_name AS payload, CASE WHEN c_custkey % 3 = 0 THEN 1000000 ELSE 0 END AS seq FROM customer)
SELECT memory_id, CASE WHEN net.seq > coalesce(t.seq, -1) THEN net.payload ELSE t.payload END AS payload, CASE WHEN net.seq > coalesce(t.seq, -1) THEN net.seq ELSE t.seq END AS sequence_id
FROM t FULL JOIN net USING (memory_id) WHERE NOT coalesce(net.seq > coalesce(t.seq, -1) AND operation = 'delete', false)"""
)
def changes_applied(spark, d):
    seq = F.when(F.col("c_custkey") % 3 == 0, 1_000_000).otherwise(0).cast("bigint")
    target = table(spark, d, "customer").select(views.key("c_custkey").alias("memory_id"), F.col("c_name").alias("payload"), seq.alias("sequence_id"))
    return outbox.live(outbox.apply_changes(target, views.outbox(spark, d)))


_FAIL = f"{S.OUTBOX}, f AS (SELECT *, seq % 20 = 0 AS permanent, (seq % 21 - 10) / 10.0::DOUBLE AS jitter FROM outbox WHERE seq % 4 = 0)"


def _failed(spark, d):
    q = views.outbox(spark, d)
    s = F.col("sequence_id")
    failures = q.where(s % 4 == 0).select("id", F.lit("no answer").alias("error"), (s % 20 == 0).alias("permanent"), ((s % 21 - 10) / 10.0).alias("jitter"))
    return outbox.after_failures(q, failures, views.at(HALF))


@REGISTER(
    f"""WITH {_FAIL} SELECT id, CAST(CASE WHEN seq % 4 = 0 THEN attempts + 1 ELSE attempts END AS INTEGER) AS attempts_made,
CASE WHEN seq % 4 = 0 THEN {HALF}000 + CAST(floor(list_extract([1, 2, 4, 8, 16, 30, 60, 120], attempts + 1) * (1.0::DOUBLE + 0.25::DOUBLE * ((seq % 21 - 10) / 10.0::DOUBLE)) * 1000) AS BIGINT) ELSE due * 1000 END AS next_ms
FROM outbox WHERE NOT (seq % 4 = 0 AND (seq % 20 = 0 OR attempts + 1 >= 8))"""
)
def retry_schedule(spark, d):
    return _failed(spark, d)[0].select("id", "attempts_made", F.unix_millis("next_attempt_at").alias("next_ms"))


@REGISTER(f"WITH {_FAIL} SELECT id, memory_id, operation AS failed_operation, CAST(attempts + 1 AS INTEGER) AS attempts_made, CASE WHEN seq % 3 = 0 THEN 'acknowledged' END AS resolution FROM f WHERE permanent OR attempts + 1 >= 8")
def dead_letters(spark, d):
    dead = _failed(spark, d)[1]
    outcomes = dead.where(F.col("id").cast("bigint") % 3 == 0).select("id", F.lit("acknowledged").alias("outcome"))
    return outbox.resolve(dead, outcomes, views.now()).select("id", "memory_id", "failed_operation", "attempts_made", "resolution")


@REGISTER(f"WITH {S.OUTBOX}, o AS (SELECT *, row_number() OVER (ORDER BY seq) AS t FROM outbox) SELECT memory_id, seq AS sequence_id FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY seq DESC) AS r FROM o WHERE t > 400) WHERE r = 1")
def queue_overflow(spark, d):
    return outbox.admit(9_600, views.outbox(spark, d))[1].select("memory_id", "sequence_id")


@REGISTER(f"WITH {_NET} SELECT memory_id, seq AS sequence_id, payload FROM net")
def pending_upsert(spark, d):
    """Last write wins for each fact."""
    q = views.outbox(spark, d).select("memory_id", "payload", "sequence_id")
    return tables.upsert_latest(q.where("sequence_id < 0"), q, ["memory_id"], "sequence_id").select("memory_id", "sequence_id", "payload")


@REGISTER("SELECT 'due' AS name, (SELECT count(*) FROM events) AS rows UNION ALL SELECT 'facts', (SELECT count(*) FROM documents)")
def queue_counts(spark, d):
    return outbox.counts(due=views.outbox(spark, d), facts=views.memories(spark, d))


def _log(spark, d):
    """Events as audit rows, not sealed yet."""
    e = table(spark, d, "events")
    fixed = {"event_id": views.key("event_id"), "timestamp": F.col("event_id").cast("string"), "event_type": F.col("event_type"), "resource_id": views.key("user_id"), "actor_kind": F.lit("agent"), "result": F.lit("ok"), "details_json": F.coalesce("props", F.lit("{}"))}
    return e.select(F.col("event_id").alias("seq"), *[fixed.get(n, F.lit(None).cast("string")).alias(n) for n in AUDIT_FIELDS])


@REGISTER(
    f"""SELECT event_id AS seq, sha256(repeat('0', 64) || '{{"event_id":"' || {S.KEY.format('event_id')} || '","timestamp":"' || event_id || '","user_id":null,"device_id":null,"event_type":"' || event_type
|| '","resource_type":null,"resource_id":"' || {S.KEY.format('user_id')} || '","boundary":null,"actor_kind":"agent","actor_name":null,"result":"ok","details_json":' || CAST(to_json(coalesce(props, '{{}}')) AS VARCHAR) || '}}') AS hash FROM events"""
)
def audit_hashes(spark, d):
    return _log(spark, d).select("seq", audit.event_hash(F.lit(audit.GENESIS), audit.audit_body()).alias("hash"))


@REGISTER("SELECT event_id AS seq, 'altered event' AS fault FROM events WHERE event_id % 50 = 7")
def audit_verification(spark, d):
    """A sealed log in which some events were altered afterwards."""
    log = audit.seal(_log(spark, d))
    return audit.verify(log.withColumn("result", F.when(F.col("seq") % 50 == 7, "denied").otherwise(F.col("result"))))


@REGISTER("SELECT event_id, round(1 / (1 + exp(-(value / 100))), 6) AS score FROM events")
def sigmoid_scores(spark, d):
    return table(spark, d, "events").select("event_id", F.round(sigmoid(F.col("value") / 100), 6).alias("score"))
