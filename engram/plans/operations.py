"""Day-to-day operation: commits, retries, dead letters, agents, checks of queries and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import audit, checkpoints, consolidate, divergence, outbox, retrieval, run, scope, transactions
from engram.plans import sql as S
from engram.plans.queues import _FAIL, HALF, _failed, _log
from engram.plans.register import Register
from engram.sources import tables, views
from engram.sources.schema import schema
from engram.sources.shared import table
from engram.sources.views import DAY, EPOCH, NOW

REGISTER = Register()
ROOM = 100


def number():
    """The number in a string id."""
    return F.col("id").cast("bigint")

_CHANGES = """changes AS (SELECT *, CASE WHEN n % 3 = 1 OR n % 6 = 3 THEN 'update' WHEN n % 6 = 2 THEN 'delete' ELSE 'write' END AS operation, n % 3 <> 0 AS stored FROM memories),
judged AS (SELECT *, CASE WHEN operation = 'write' AND stored THEN 'exists' WHEN operation <> 'write' AND NOT stored THEN 'missing' END AS fault FROM changes),
placed AS (SELECT *, row_number() OVER (ORDER BY n) - 1 AS place FROM judged WHERE fault IS NULL)"""


def _commit(spark, d):
    """Every third fact is not stored yet; each fact changes once, and 100 entries fit."""
    facts = views.memories(spark, d)
    n = F.col("turn")
    operation = F.when((n % 3 == 1) | (n % 6 == 3), "update").when(n % 6 == 2, "delete").otherwise("write")
    changes = facts.withColumn("turn", number()).withColumn("operation", operation).withColumn("content", F.concat(F.lit("new "), "content")).withColumn("embedding", F.array(F.lit(0.5).cast("float")))
    return transactions.commit(facts.where(number() % 3 != 0), changes, views.now(), depth=outbox.MAX_DEPTH - ROOM)


@REGISTER(
    f"""WITH {S.MEMORIES}, {_CHANGES} SELECT id, operation, CASE WHEN fault IS NOT NULL THEN fault WHEN place < {ROOM} THEN 'queued' ELSE 'pending' END AS outcome,
CAST(1 + place + CASE WHEN place > {ROOM} THEN 1 ELSE 0 END AS BIGINT) AS sequence_id FROM judged LEFT JOIN (SELECT id, place FROM placed) USING (id)"""
)
def commit_outcomes(spark, d):
    """What became of each change of a batch: refused, queued, or waiting, with its number."""
    made = _commit(spark, d)
    refused = made.refused.select("id", "operation", F.col("fault").alias("outcome"), F.lit(None).cast("bigint").alias("sequence_id"))
    queued = made.queue.select(F.col("memory_id").alias("id"), "operation", F.lit("queued").alias("outcome"), "sequence_id")
    return refused.unionByName(queued).unionByName(made.pending.select(F.col("memory_id").alias("id"), "operation", F.lit("pending").alias("outcome"), "sequence_id"))


@REGISTER(
    f"""WITH {S.MEMORIES}, step AS (SELECT id, n, n % 3 <> 0 AS stored, unnest(CASE WHEN n % 2 = 0 THEN range(6) ELSE range(4) END) AS step FROM memories)
SELECT id, CAST(step AS INTEGER) AS step, CASE WHEN step IN (0, 2) THEN 'unknown operation' WHEN step = 1 AND NOT stored OR step = 5 THEN 'missing' WHEN step = 3 AND stored THEN 'exists' END AS fault FROM step"""
)
def commit_unknown_operations(spark, d):
    """Changes without an operation that is known, or with none, before each kind that is: they tell nothing about the fact."""
    steps = F.when(number() % 2 == 0, F.sequence(F.lit(0), F.lit(5))).otherwise(F.sequence(F.lit(0), F.lit(3)))
    kinds = F.array(F.when(number() % 5 != 0, F.lit("rename")), *[F.lit(x) for x in ("update", "rename", "write", "delete", "update")])
    facts = views.memories(spark, d).select("id")
    changes = facts.select("id", F.explode(steps).alias("step")).withColumn("operation", kinds[F.col("step")]).withColumn("turn", number() * 6 + F.col("step"))
    return transactions.judged(facts.where(number() % 3 != 0), changes).select("id", "step", "fault")


@REGISTER(
    f"""WITH {S.MEMORIES}, {_CHANGES} SELECT id, CASE WHEN fault IS NULL THEN 'new ' || content ELSE content END AS content, boundary FROM judged
WHERE (stored AND (operation <> 'delete')) OR (NOT stored AND fault IS NULL)"""
)
def commit_facts(spark, d):
    """The facts after the commit."""
    return _commit(spark, d).memories.select("id", "content", "boundary")


@REGISTER(
    f"""WITH {S.MEMORIES}, {_CHANGES} SELECT CAST(1 + place + CASE WHEN place > {ROOM} THEN 1 ELSE 0 END AS BIGINT) AS seq,
CASE operation WHEN 'write' THEN 'memory.create' WHEN 'update' THEN 'memory.update' ELSE 'memory.delete' END AS event_type, id AS resource_id, boundary, 'success' AS result FROM placed
UNION ALL SELECT {ROOM + 2}, 'cascade.queue_overflow', NULL, NULL, 'error' FROM placed WHERE place = {ROOM}"""
)
def commit_events(spark, d):
    """Its audit events, with one for the start of the overflow."""
    return _commit(spark, d).events.select("seq", "event_type", "resource_id", "boundary", "result")


@REGISTER(f"WITH {S.MEMORIES}, {_CHANGES}, e AS (SELECT 1 + place + CASE WHEN place > {ROOM} THEN 1 ELSE 0 END AS seq FROM placed UNION ALL SELECT {ROOM + 2} FROM placed WHERE place = {ROOM}) SELECT CAST(seq AS BIGINT) AS seq, 'altered event' AS fault FROM e WHERE seq % 7 = 3")
def commit_chain(spark, d):
    """The sealed events of a commit, every seventh altered afterwards."""
    log = audit.seal(_commit(spark, d).events)
    return audit.verify(log.withColumn("result", F.when(F.col("seq") % 7 == 3, "denied").otherwise(F.col("result"))))


@REGISTER("SELECT event_id AS seq, event_type FROM events ORDER BY event_id LIMIT 100")
def audit_listing(spark, d):
    return audit.listing(_log(spark, d), 100).select("seq", "event_type")


@REGISTER(f"WITH {S.MEMORIES}, one AS (SELECT id FROM memories ORDER BY id LIMIT 1 OFFSET 7) SELECT m.id, boundary, superseded_by FROM memories m JOIN one USING (id)")
def point_lookup(spark, d):
    """One fact by id: the eighth of the table."""
    m = views.memories(spark, d)
    return scope.get(m, m.orderBy("id").limit(8).select("id").tail(1)[0].id).select("id", "boundary", "superseded_by")


@REGISTER(f"WITH {_FAIL} SELECT id, memory_id, CAST(attempts + 1 AS INTEGER) AS attempts_made FROM f WHERE (permanent OR attempts + 1 >= 8) AND seq % 3 <> 0 ORDER BY id LIMIT 50")
def dead_letters_unresolved(spark, d):
    dead = _failed(spark, d)[1]
    outcomes = dead.where(number() % 3 == 0).select("id", F.lit("acknowledged").alias("outcome"))
    return outbox.unresolved(outbox.resolve(dead, outcomes, views.now()), 50).select("id", "memory_id", "attempts_made")


_OVER = f"""{S.OUTBOX}, o AS (SELECT *, row_number() OVER (ORDER BY seq) AS t FROM outbox),
over AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY seq DESC) AS r FROM o WHERE t > 400) WHERE r = 1)"""


def _pending(spark, d):
    return outbox.admit(9_600, views.outbox(spark, d))[1].withColumn("queued_at", F.col("created_at"))


@REGISTER(f"WITH {_OVER} SELECT memory_id, CAST({EPOCH} + seq AS BIGINT) AS queued_s FROM over ORDER BY queued_s, memory_id LIMIT 60")
def pending_oldest(spark, d):
    return outbox.oldest_pending(_pending(spark, d), 60).select("memory_id", F.unix_seconds("queued_at").alias("queued_s"))


@REGISTER(
    f"""WITH {_OVER}, fit AS (SELECT memory_id FROM over WHERE payload IS NOT NULL ORDER BY seq, memory_id LIMIT 25)
SELECT memory_id, memory_id IN (SELECT memory_id FROM fit) AS fits FROM over"""
)
def pending_drain(spark, d):
    """Waiting entries for which there is room again, oldest first, and the rest."""
    fits, rest = outbox.drain(outbox.MAX_DEPTH - 25, _pending(spark, d))
    return fits.select("memory_id", F.lit(True).alias("fits")).unionByName(rest.select("memory_id", F.lit(False).alias("fits")))


_TARGET = f"target AS (SELECT {S.KEY.format('c_custkey')} AS memory_id, c_name AS payload FROM customer)"


def _target(spark, d):
    return table(spark, d, "customer").select(views.key("c_custkey").alias("memory_id"), F.col("c_name").alias("payload"), F.lit(0).cast("bigint").alias("sequence_id"))


def _stepped(spark, d):
    s = F.col("sequence_id")
    failures = views.outbox(spark, d).where(s % 4 == 0).select("id", F.lit("no answer").alias("error"), (s % 20 == 0).alias("permanent"), F.lit(0.0).alias("jitter"))
    return outbox.retry_step(_target(spark, d), views.outbox(spark, d), views.at(HALF), failures)


@REGISTER(
    f"""WITH {S.OUTBOX}, {_TARGET}, done AS (SELECT memory_id, max(seq) AS seq, arg_max(operation, seq) AS operation, arg_max(payload, seq) AS payload FROM outbox WHERE due <= {HALF} AND seq % 4 <> 0 GROUP BY memory_id)
SELECT memory_id, CASE WHEN seq > 0 THEN done.payload ELSE target.payload END AS payload, CASE WHEN seq > 0 THEN seq ELSE 0 END AS sequence_id
FROM target FULL JOIN done USING (memory_id) WHERE NOT coalesce(operation = 'delete' AND seq > coalesce(CASE WHEN target.memory_id IS NULL THEN -1 ELSE 0 END, -1), false)"""
)
def retry_state(spark, d):
    """Facts after one step of the worker: due entries were tried, every fourth failed."""
    return outbox.live(_stepped(spark, d)[0])


@REGISTER(
    f"""WITH {S.OUTBOX} SELECT id, 'queued' AS place FROM outbox WHERE NOT (due <= {HALF} AND (seq % 4 <> 0 OR seq % 20 = 0 OR attempts + 1 >= 8))
UNION ALL SELECT id, 'dead' FROM outbox WHERE due <= {HALF} AND seq % 4 = 0 AND (seq % 20 = 0 OR attempts + 1 >= 8)"""
)
def retry_queues(spark, d):
    """Where the entries are after the step: still queued or dead."""
    _, left, dead = _stepped(spark, d)
    return left.select("id", F.lit("queued").alias("place")).unionByName(dead.select("id", F.lit("dead").alias("place")))


@REGISTER(f"WITH {_FAIL} SELECT id, CASE WHEN seq % 3 <> 0 THEN NULL WHEN seq % 2 = 0 THEN 'retried_failed' ELSE 'retried_succeeded' END AS resolution FROM f WHERE permanent OR attempts + 1 >= 8")
def dead_letter_replay(spark, d):
    """Every third dead letter is tried again by hand; those of even numbers fail again."""
    dead = _failed(spark, d)[1]
    ids = dead.where(number() % 3 == 0).select("id")
    return outbox.replay(_target(spark, d), dead, ids, ids.where(number() % 2 == 0), views.now())[1].select("id", "resolution")


@REGISTER("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new name' ELSE c_name END AS c_name, false AS missing FROM customer UNION ALL SELECT -c_custkey, NULL, true FROM customer WHERE c_custkey % 4 = 1")
def full_row_updates(spark, d):
    """Full-row updates of every fourth customer, and updates of keys that do not exist."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    changes = c.where(k % 4 == 0).withColumn("c_name", F.lit("new name")).unionByName(c.where(k % 4 == 1).withColumn("c_custkey", -k))
    after, missing = tables.update_rows(c, changes, "c_custkey")
    return after.withColumn("missing", F.lit(False)).unionByName(missing.select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.lit(True).alias("missing")))


@REGISTER(
    f"""SELECT sha256(s_name) AS token_hash, 'agent ' || (s_suppkey % 3) AS agent_name, CASE WHEN s_suppkey % 3 = 0 THEN ['en', 'fr'] ELSE ['de'] END AS boundaries,
CASE WHEN s_suppkey % 3 = 1 THEN {NOW} END AS revoked_s FROM supplier"""
)
def agent_tokens(spark, d):
    """Tokens of three agents: one gets other scopes, one is revoked and keeps its rows."""
    nothing = spark.createDataFrame([], schema("agent_tokens"))
    name = F.concat(F.lit("agent "), (F.col("s_suppkey") % 3).cast("string"))
    rows = table(spark, d, "supplier").select(F.sha2(F.col("s_name"), 256).alias("token_hash"), name.alias("agent_name"), F.array(F.lit("de")).alias("boundaries"), views.at(EPOCH).alias("created_at"), F.lit(None).cast("timestamp").alias("revoked_at"))
    told = tables.set_agent_boundaries(tables.register_agent(nothing, rows), "agent 0", ["en", "fr"])
    return tables.revoke_agent(told, "agent 1", views.now()).select("token_hash", "agent_name", "boundaries", F.unix_seconds("revoked_at").alias("revoked_s"))


_TEXTS = "texts AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '  ' WHEN 1 THEN 'a' || chr(9) || 'b' WHEN 2 THEN chr(10) || 'a ' WHEN 3 THEN repeat('é', 1024) WHEN 4 THEN repeat('é', 1024) || 'x' ELSE substr(text, 1, 40) END AS text FROM documents)"


@REGISTER(
    f"""WITH {_TEXTS}, judged AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'empty' WHEN 4 THEN 'too long' END AS base, text FROM texts)
SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'control' WHEN doc_id % 6 = 5 AND regexp_matches(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[\\x00-\\x1F\\x7F]') THEN 'control'
  WHEN doc_id % 6 = 5 AND trim(text) = '' THEN 'empty' ELSE base END AS to_embed, CASE WHEN doc_id % 6 = 5 AND trim(text) = '' THEN 'empty' ELSE base END AS keyword FROM judged"""
)
def query_faults(spark, d):
    """Texts at both sides of every border of a valid query."""
    n = F.col("doc_id") % 6
    text = F.when(n == 0, "  ").when(n == 1, "a\tb").when(n == 2, "\na ").when(n == 3, "é" * 1024).when(n == 4, "é" * 1024 + "x").otherwise(F.substring("text", 1, 40))
    texts = table(spark, d, "documents").select("doc_id", text.alias("text"))
    return texts.select("doc_id", retrieval.query_fault(F.col("text")).alias("to_embed"), retrieval.query_fault(F.col("text"), to_embed=False).alias("keyword"))


_GROUPS = "groups AS (SELECT *, n // 5 AS g FROM memories), chosen AS (SELECT *, lpad(CAST(g AS VARCHAR), 12, '0') AS cluster_id, g % 3 AS kind, CASE WHEN g % 3 = 0 THEN lpad(CAST(g * 5 AS VARCHAR), 12, '0') END AS winner FROM groups)"


def _winners(spark, d):
    m = views.memories(spark, d)
    g = F.floor(number() / 5)
    members = m.select(F.lpad(g.cast("string"), 12, "0").alias("cluster_id"), "id")
    kind = F.col("cluster_id").cast("bigint") % 3
    first = F.lpad((F.col("cluster_id").cast("bigint") * 5).cast("string"), 12, "0")
    decisions = members.select("cluster_id").distinct().select("cluster_id", F.when(kind == 2, "keep_separate").otherwise("contradiction").alias("decision"), F.when(kind == 0, first).alias("winner"))
    return run._winner_takes(m, members, decisions, views.now())


@REGISTER(f"WITH {S.MEMORIES}, {_GROUPS} SELECT id, CASE WHEN kind = 0 AND id <> winner AND starts <= {NOW} THEN {NOW} ELSE ends END AS ends_s FROM chosen")
def winner_takes(spark, d):
    """Facts after contradictions with a winner: the losers end now."""
    return _winners(spark, d)[0].select("id", F.unix_seconds("valid_until").alias("ends_s"))


@REGISTER(f"WITH {S.MEMORIES}, {_GROUPS} SELECT cluster_id, list(id ORDER BY id) AS ids FROM chosen WHERE kind = 1 GROUP BY cluster_id")
def contradiction_review(spark, d):
    """Contradictions without a winner wait for a person."""
    return _winners(spark, d)[1]


@REGISTER(f"WITH {S.MEMORIES} SELECT id, CASE WHEN n % 5 = 0 THEN {S.KEY.format('n + 5')} ELSE superseded_by END AS superseded_by FROM memories")
def superseded_chain(spark, d):
    """Every fifth fact is replaced by the next fifth one; older marks are overwritten."""
    m = views.memories(spark, d)
    links = m.where(number() % 5 == 0).select("id", F.lpad((number() + 5).cast("string"), 12, "0").alias("by"))
    return consolidate.mark_superseded(m, links).select("id", "superseded_by")


@REGISTER(f"WITH {S.MEMORIES} SELECT id, created >= {EPOCH + 6000} AS recent FROM memories WHERE id NOT IN (SELECT {S.KEY.format('vec_id')} FROM embeddings WHERE vec_id % 3 <> 0)")
def divergence_strata(spark, d):
    """Facts without a vector by stratum; as many samples as there are facts, so every one is drawn."""
    m = views.memories(spark, d)
    now = views.at(EPOCH + 6000 + divergence.WINDOW_DAYS * DAY)
    return divergence.sampled_missing(m, views.vectors(spark, d).where(number() % 3 != 0), now, seed=7, samples=m.count())


@REGISTER(
    """WITH head AS (SELECT 'c' || o_orderkey AS checkpoint_id, epoch(CAST(o_orderdate AS TIMESTAMP)) AS created_s, o_orderkey % 2 AS odd FROM orders)
SELECT checkpoint_id, CAST(created_s AS BIGINT) AS created_s, CASE WHEN odd = 1 THEN 'rolled_back' ELSE 'active' END AS status FROM head ORDER BY created_s DESC, checkpoint_id DESC LIMIT 7"""
)
def checkpoint_listing(spark, d):
    """The newest checkpoints that retention keeps."""
    odd = F.col("o_orderkey") % 2 == 1
    heads = table(spark, d, "orders").select(
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("checkpoint_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(odd, checkpoints.ROLLED_BACK).otherwise(checkpoints.ACTIVE).alias("status"), F.lit(1).cast("bigint").alias("entries"),
    )
    kept = checkpoints.retained(heads, heads.select("checkpoint_id"))[0]
    return checkpoints.listing(kept).select("checkpoint_id", F.unix_seconds("created_at").alias("created_s"), "status")
