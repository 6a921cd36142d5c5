import random

import pandas as pd
from pyspark.sql import functions as F

from engram.streaming import retries
from engram.streaming.incremental import change_stream

BACKOFF = (0.1, 0.1, 0.2, 0.2)


def answer(asked: pd.DataFrame) -> pd.DataFrame:
    """A change goes through at attempt ``sequence_id % 6``; every tenth has a permanent error."""
    fails = (asked["attempts_made"] < asked["sequence_id"] % 6) | (asked["sequence_id"] % 10 == 0)
    return pd.DataFrame({"error": ["no answer" if f else None for f in fails], "permanent": asked["sequence_id"] % 10 == 0, "jitter": (asked["sequence_id"] % 3 - 1) / 1.0})


def brute(entries):
    """State and dead letters, each change for itself."""
    state, dead = {}, {}
    for name, fact, operation, payload, seq in entries:
        if seq % 10 == 0:
            dead[name] = 1
        elif seq % 6 >= len(BACKOFF):
            dead[name] = len(BACKOFF)
        elif fact not in state or state[fact][0] < seq:
            state[fact] = (seq, None if operation == "delete" else payload, operation == "delete")
    return state, dead


def queue(spark, entries):
    rows = [(n, f, o, p, s, 0) for n, f, o, p, s in entries]
    return spark.createDataFrame(rows, "id string, memory_id string, operation string, payload string, sequence_id bigint, attempts_made int").withColumns({"next_attempt_at": F.timestamp_seconds(F.lit(10)), "created_at": F.timestamp_seconds(F.lit(5))})


def test_stream_is_the_batch_however_changes_come(spark, tmp_path):
    """Shuffled and repeated micro-batches, and a run that is taken up again."""
    rng = random.Random(2)
    entries = [(f"e{s:03}", f"f{rng.randrange(12)}", rng.choice(["write", "update", "delete"]), f"p{s}", s) for s in range(120)]
    shuffled = entries + rng.sample(entries, 30)
    rng.shuffle(shuffled)
    for lo in range(0, len(shuffled), 50):
        queue(spark, shuffled[lo : lo + 50]).coalesce(1).write.mode("append").parquet(str(tmp_path / "queue"))
    changes = change_stream(spark, str(tmp_path / "queue"), queue(spark, entries[:1]).schema)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    first = retries.run(changes, retries.RetryWorker(answer, BACKOFF), out, ck, every="200 milliseconds")
    retries.drained(first, spark, out, 40, 120)
    again = retries.run(changes, retries.RetryWorker(answer, BACKOFF), out, ck, every="200 milliseconds")
    rows = retries.drained(again, spark, out, len(entries), 120)
    state, dead = brute(entries)
    assert {r.memory_id: (r.sequence_id, r.payload, r.deleted) for r in retries.state_of(rows).collect()} == state
    assert {r.id: r.attempts_made for r in retries.dead_letters_of(rows).collect()} == dead


def test_deleted_facts_are_kept_for_a_while_and_older_state_counts(spark, tmp_path):
    entries = [("a", "x", "delete", None, 7), ("b", "y", "write", "old", 7), ("c", "z", "write", "new", 7)]
    queue(spark, entries).coalesce(1).write.parquet(str(tmp_path / "queue"))
    changes = change_stream(spark, str(tmp_path / "queue"), queue(spark, entries).schema)
    start = spark.createDataFrame([("y", 50, False), ("z", 3, False)], "memory_id string, sequence_id bigint, deleted boolean")
    good = lambda asked: pd.DataFrame({"error": [None] * len(asked), "permanent": [False] * len(asked), "jitter": [0.0] * len(asked)})
    out = str(tmp_path / "out")
    running = retries.run(changes, retries.RetryWorker(good, BACKOFF, keep_deleted=0.5), out, str(tmp_path / "ck"), start, "200 milliseconds")
    import time

    for _ in range(120):
        time.sleep(0.5)
        if running.lastProgress and retries.read_settled(spark, out).where("kind = 'forgotten'").count():
            break
    rows = retries.drained(running, spark, out, 3, 60)
    assert {(r.kind, r.memory_id) for r in rows.collect()} == {("applied", "x"), ("forgotten", "x"), ("older", "y"), ("applied", "z")}
