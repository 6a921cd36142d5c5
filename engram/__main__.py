"""Command line.

``list`` and ``run`` show the queries; all other commands work on a store folder.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import re
import secrets
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import audit, checkpoints, divergence, outbox
from engram.operators.run import consolidation_run
from engram.plans.catalog import QUERIES
from engram.session import prepare
from engram.sources import tables
from engram.sources.schema import BOUNDARY_PATTERN
from engram.sources.store import StoreFolder
from engram.timeouts import consolidation_seconds, within

PAGE = 100
PAYLOAD = "embedding array<float>, boundary string"


class Refused(Exception):
    """A command that cannot be carried out; its message goes to the user."""


def _print(rows: DataFrame, most: int = PAGE) -> None:
    for r in rows.limit(most).collect():
        print(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))


def _letter(store: StoreFolder, key: str):
    found = store.read("dead_letter").where(F.col("id") == key).first()
    if found is None:
        raise Refused(f"no dead letter {key}")
    return found


def dead_letter(store: StoreFolder, args, now) -> None:
    """``list``, ``inspect``, ``retry`` and ``acknowledge``."""
    dead = store.read("dead_letter")
    if args.action == "list":
        _print(outbox.unresolved(dead, args.limit), args.limit)
        return
    letter = _letter(store, args.id)
    if args.action == "inspect":
        print(json.dumps(letter.asDict(), default=str, ensure_ascii=False))
        return
    if letter.resolution is not None:
        print(f"already {letter.resolution}")
        return
    one = store.spark.createDataFrame([(args.id,)], "id string")
    if args.action == "acknowledge":
        if not args.reason.strip():
            raise Refused("a reason is needed")
        outcome, vectors = "acknowledged", None
    else:
        vectors = _replayed(store, letter)
        outcome = "retried_failed" if vectors is None else "retried_succeeded"
    after = {"dead_letter": outbox.resolve(dead, one.withColumn("outcome", F.lit(outcome)), now)}
    store.commit(**after, **({} if vectors is None else {"vectors": vectors}))
    print(outcome if args.action == "retry" else f"{outcome}: {args.reason.strip()}")


def _replayed(store: StoreFolder, letter) -> DataFrame | None:
    """The vector table after the letter's change, or None where its payload cannot be read."""
    vectors = store.read("vectors")
    if letter.failed_operation == "delete":
        return tables.delete(vectors, store.spark.createDataFrame([(letter.memory_id,)], "id string"))
    row = store.spark.createDataFrame([(letter.memory_id, letter.payload)], "id string, payload string")
    made = row.select("id", F.from_json("payload", PAYLOAD).alias("p")).select("id", "p.embedding", "p.boundary")
    broken = F.col("embedding").isNull() | F.col("boundary").isNull() | F.exists(F.coalesce("embedding", F.array()), lambda x: x.isNull())
    return None if not made.where(broken).isEmpty() else tables.upsert(vectors, made, ["id"])


def divergence_check(store: StoreFolder, args, now) -> int:
    """Counts and missing rows; 1 where the tables differ."""
    memories, vectors = store.read("memories"), store.read("vectors")
    counts = divergence.count_check(memories, vectors).first()
    missing = divergence.all_missing(memories, vectors)
    print(json.dumps(counts.asDict()))
    _print(missing.orderBy("missing_in", "id"))
    return int(bool(counts.differ) or not missing.isEmpty())


def checkpoint(store: StoreFolder, args, now) -> None:
    heads = store.read("checkpoints")
    if args.action == "list":
        _print(checkpoints.listing(heads))
        return
    try:
        heads, memories = checkpoints.roll_back(heads, store.read("checkpoint_entries"), store.read("memories"), args.id)
    except checkpoints.UnknownCheckpoint:
        raise Refused(f"no checkpoint {args.id}") from None
    except checkpoints.AlreadyRolledBack:
        raise Refused(f"checkpoint {args.id} was rolled back before") from None
    store.commit(checkpoints=heads, memories=memories)
    print(f"rolled back {args.id}")


def consolidate(store: StoreFolder, args, now) -> None:
    """One run without models: duplicates, decay and archive, with a checkpoint of what changed."""
    key = f"run-{args.now.strftime('%Y%m%dT%H%M%S%f')}"

    def job() -> None:
        ran = consolidation_run(store.read("memories"), store.read("vectors"), now)
        _print(ran.counts.orderBy("boundary"))
        if ran.entries.where("change_type <> 'deleted'").isEmpty():
            print("nothing to change")
            return
        heads, entries = checkpoints.record(store.read("checkpoints"), store.read("checkpoint_entries"), ran.entries, key, now)
        heads, entries = checkpoints.retained(heads, entries)
        store.commit(memories=ran.state, checkpoints=heads, checkpoint_entries=entries)
        print(key)

    within(store.spark, consolidation_seconds(), job)


def agent(store: StoreFolder, args, now) -> None:
    """``add`` prints the token once; only its hash is stored."""
    tokens = store.read("agent_tokens")
    if args.action == "list":
        _print(tokens.drop("token_hash").orderBy("agent_name", "created_at"))
        return
    open_ = tokens.where((F.col("agent_name") == args.name) & F.col("revoked_at").isNull())
    known = not open_.isEmpty()
    if args.action == "add":
        if known:
            raise Refused(f"agent {args.name} is there already")
        token = secrets.token_hex(32)
        row = [(hashlib.sha256(token.encode()).hexdigest(), args.name, args.boundary, args.now, None)]
        after = tables.register_agent(tokens, store.spark.createDataFrame(row, tokens.schema))
        print(token)
    elif not known:
        raise Refused(f"no agent {args.name}")
    elif args.action == "set-boundaries":
        after = tables.set_agent_boundaries(tokens, args.name, args.boundary)
    else:
        after = tables.revoke_agent(tokens, args.name, now)
    store.commit(agent_tokens=after)


def verify_audit(store: StoreFolder, args, now) -> int:
    log = store.read("audit_log")
    faults = log.limit(0).select("seq") if log.isEmpty() else audit.verify(log)
    _print(faults.orderBy("seq"))
    return int(not faults.isEmpty())


def sweep(store: StoreFolder, args, now) -> None:
    store.sweep()


def boundary(text: str) -> str:
    if not re.fullmatch(BOUNDARY_PATTERN, text):
        raise argparse.ArgumentTypeError(f"{text!r} is no boundary")
    return text


def moment(text: str) -> datetime:
    found = datetime.fromisoformat(text)
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m engram", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("--store", help="folder of the store")
    top.add_argument("--now", type=moment, default=None, help="the time that the command takes for now")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="rows of one query")
    run.add_argument("name", choices=sorted(QUERIES), metavar="NAME")
    run.add_argument("folder")

    letters = commands.add_parser("dead-letter").add_subparsers(dest="action", required=True)
    letters.add_parser("list").add_argument("--limit", type=int, default=PAGE)
    for name in ("inspect", "retry"):
        letters.add_parser(name).add_argument("id")
    taken = letters.add_parser("acknowledge")
    taken.add_argument("id")
    taken.add_argument("--reason", required=True)

    commands.add_parser("divergence-check")
    points = commands.add_parser("checkpoint").add_subparsers(dest="action", required=True)
    points.add_parser("list")
    points.add_parser("rollback").add_argument("id")
    commands.add_parser("consolidate").add_subparsers(dest="action", required=True).add_parser("run")

    agents = commands.add_parser("agent").add_subparsers(dest="action", required=True)
    agents.add_parser("list")
    agents.add_parser("revoke").add_argument("name")
    for name in ("add", "set-boundaries"):
        one = agents.add_parser(name)
        one.add_argument("name")
        one.add_argument("--boundary", action="append", required=True, type=boundary)
    commands.add_parser("verify-audit")
    commands.add_parser("sweep", help="remove versions that no manifest names; while nobody writes")
    return top


COMMANDS = {"dead-letter": dead_letter, "divergence-check": divergence_check, "checkpoint": checkpoint, "consolidate": consolidate, "agent": agent, "verify-audit": verify_audit, "sweep": sweep}


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    """Runs one command; 0 where all is well, 1 where a check finds a fault or a command is refused."""
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = prepare(spark or SparkSession.builder.getOrCreate())
    if args.command == "run":
        QUERIES[args.name](spark, args.folder).show(50, truncate=80)
        return 0
    if not args.store:
        parser().error("--store is needed")
    args.now = args.now or datetime.now(timezone.utc)
    try:
        now = F.lit(args.now.astimezone(timezone.utc).isoformat()).cast("timestamp")
        return COMMANDS[args.command](StoreFolder(spark, args.store), args, now) or 0
    except Refused as why:
        print(f"error: {why}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
