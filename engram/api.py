"""The store as an agent sees it: search, read, write, update and delete within a scope.

The scope of a caller comes from its token, never from the arguments of a call. State is kept
as tables; each change writes a new version to shared storage and the one before is dropped,
so plans stay short. For bulk work use the operators on whole tables instead.
"""

from __future__ import annotations

import secrets
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.jsons import AUDIT_FIELDS
from engram.functions.text import canonical_form, rerank_prompt
from engram.operators import audit, bm25, evaluate, retrieval, scope
from engram.sources import tables
from engram.sources.schema import MEMORY_TYPES, schema, validate_memories
from engram.sources.shared import drop, materialise

DEFAULT_RESULTS = 10
DEFAULT_CONFIDENCE = 0.9
#: Segments of the keyword index before they are written as one.
MOST_SEGMENTS = 16
ACCESS_DENIED = -32001
#: Best vector matches whose mean cosine opens a read without a scorer.
GATE_TOP = 1
REPORT_HEADER = "boundary string, schema_version int, generated_at timestamp, topic_names_unavailable boolean, topics array<struct<id:string,topic:string>>"


class StoreError(Exception):
    """Base of all errors; ``code`` is what goes over a wire, the message names no content."""

    code = -32000


class AccessDenied(StoreError):
    code = ACCESS_DENIED


class InvalidInput(StoreError):
    code = -32602


class NotFound(StoreError):
    code = -32004


def time_ordered_id(now: datetime) -> str:
    """A version 7 UUID: milliseconds first, so text order is time order."""
    bits = (int(now.timestamp() * 1000) << 80) | (0x7 << 76) | (secrets.randbits(12) << 64) | (0b10 << 62) | secrets.randbits(62)
    return str(uuid.UUID(int=bits))


class ModelUnavailable(Exception):
    """Raised by a scorer whose model is not there; the search goes on without it."""


class Reading(NamedTuple):
    """What a read answers. ``boundary`` is set where the caller has one scope only."""

    boundary: str | None
    query: str
    facts: list[dict]
    abstain: bool
    top_relevance: float
    status: str
    warnings: list[tuple[str, str, str]]


class FactStore:
    """``embed`` turns texts into vectors; ``now`` is the clock."""

    def __init__(
        self,
        spark: SparkSession,
        embed: Callable[[list[str]], list[list[float]]],
        now: Callable[[], datetime] | None = None,
        score: Callable[[str, list[str]], list[float]] | None = None,
        reports: Callable[[], DataFrame] | None = None,
    ):
        """``score`` gives the relevance logits of texts for a query; ``reports`` loads the report headers and ``topics`` of facts."""
        self.spark, self.embed, self.score, self.reports = spark, embed, score, reports
        self.now = now or (lambda: datetime.now(timezone.utc))
        self.memories = materialise(spark.createDataFrame([], schema("memories")), "memories")
        self.vectors = materialise(spark.createDataFrame([], schema("vectors")), "vectors")
        self.index = bm25.build_index(self.memories)
        self.calls: list[tuple[str, int, int]] = []
        self.events: list[tuple] = []

    def _replace(self, name: str, rows: DataFrame) -> None:
        old = getattr(self, name)
        setattr(self, name, materialise(rows, name))
        drop(old)

    def _reindex(self, key: str) -> None:
        """The keyword index after a change of one fact; searches read it as it is."""
        one = self.spark.createDataFrame([(key,)], "id string")
        index = bm25.upsert_index(self.index, self.memories.join(one, "id", "left_semi"), one)
        self.index = bm25.compacted(index) if index.segments > MOST_SEGMENTS else index

    def _audit(self, kind: str, key: str | None, boundary: str | None, result: str = "success") -> None:
        """One event a change or point lookup; the chain is sealed by ``audit_log``."""
        body = {"event_id": time_ordered_id(self.now()), "timestamp": self.now().isoformat(), "event_type": kind, "resource_type": "memory", "resource_id": key, "boundary": boundary, "actor_kind": "agent", "result": result, "details_json": "{}"}
        self.events.append((len(self.events) + 1, *[body.get(n) for n in AUDIT_FIELDS]))

    def audit_log(self) -> DataFrame:
        """The events so far as a sealed chain."""
        return audit.seal(self.spark.createDataFrame(self.events, "seq long, " + ", ".join(f"{n} string" for n in AUDIT_FIELDS)))

    def get(self, boundaries: list[str], key: str):
        """One fact by id, or None where it is missing or out of scope; the read is audited."""
        found = scope.get(self.memories, key).where(scope.in_scope(boundaries)).first()
        self._audit("memory.read", key, None if found is None else found.boundary, "success" if found is not None else "error")
        return found

    def _log(self, tool: str, length: int, results: int) -> None:
        """Counts and lengths of a call, never its content."""
        self.calls.append((tool, length, results))

    def _at(self):
        return F.lit(self.now().isoformat()).cast("timestamp")

    def _queries(self, text: str, boundaries: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(0, text, [float(x) for x in self.embed([text])[0]], boundaries)], "query_id int, text string, embedding array<float>, scopes array<string>")

    def memory_search(self, boundaries: list[str], query: str, max_results: int = DEFAULT_RESULTS, threshold: float | None = None) -> DataFrame:
        """Vector and keyword search, reranked where there is a scorer: ``id, content, boundary, score, rank``.

        With a scorer the threshold concerns its relevance, else the cosine.
        """
        try:
            retrieval.check_query(query, max_results)
        except ValueError as bad:
            raise InvalidInput(str(bad)) from None
        asked, now = self._queries(query, boundaries), self._at()
        if self.score is None:
            hits = retrieval.hybrid(asked, self.vectors, self.index, self.memories, now, max_results, threshold)
        else:
            base = retrieval.hybrid(asked, self.vectors, self.index, self.memories, now, retrieval.FANOUT)
            near = retrieval.semantic(asked, self.vectors, self.memories, now, retrieval.FANOUT)
            hits = self._reranked(query, retrieval.union_distinct(near, base), max_results, threshold)[0]
        found = hits.join(self.memories.where(scope.in_scope(boundaries)).select("id", "content", "boundary"), "id").select("id", "content", "boundary", "score", "rank")
        rows = found.orderBy("rank").collect()
        self._log("memory_search", len(query), len(rows))
        return self.spark.createDataFrame(rows, found.schema)

    def _reranked(self, query: str, pooled: DataFrame, max_results: int, threshold: float | None = None) -> tuple[DataFrame, bool]:
        """The pool by the scorer, and whether it answered; the pool in its own order where the model is not there."""
        pooled = pooled.cache()
        some = retrieval.scored_part(pooled).join(self.memories.select("id", "content"), "id").select("id", rerank_prompt(F.col("content")).alias("content")).collect()
        try:
            logits = self.score(query, [r.content for r in some]) if some else []
        except ModelUnavailable:
            return retrieval.reranked(pooled, None, max_results, threshold), False
        told = self.spark.createDataFrame([(0, r.id, float(x)) for r, x in zip(some, logits, strict=True)], "query_id int, id string, logit double")
        return retrieval.reranked(pooled, told, max_results, threshold), True

    def memory_read(self, boundaries: list[str], query: str, max_candidates: int = retrieval.FANOUT, floor: float = retrieval.COSINE_FLOOR) -> Reading:
        """Facts with their topics, a hint whether to abstain, and the health of the reports read.

        With a scorer every candidate is returned and abstaining is a hint only. Without one
        the mean of the best cosines must reach ``floor``, else the answer is empty.
        """
        try:
            retrieval.check_query(query, max_candidates)
        except ValueError as bad:
            raise InvalidInput(str(bad)) from None
        echo = query.strip()
        own = boundaries[0] if len(boundaries) == 1 else None
        if not boundaries:
            return Reading(own, echo, [], True, 0.0, "ok", [])
        asked, now = self._queries(echo, boundaries), self._at()
        heads = self.reports() if self.reports else self.spark.createDataFrame([], REPORT_HEADER)
        warned = retrieval.report_warnings(asked, heads, now)
        told = [(r.boundary, r.code, r.severity) for r in warned.orderBy("position", "turn").collect()]
        status = retrieval.read_status(asked, warned).first().status
        base = retrieval.hybrid(asked, self.vectors, self.index, self.memories, now, max_candidates)
        near = retrieval.semantic(asked, self.vectors, self.memories, now, max_candidates)
        if self.score is not None:
            hits, scored = self._reranked(echo, retrieval.read_pool(base, near), 2 * max_candidates)
        else:
            best = evaluate.mean_top(near, GATE_TOP).first()
            hits, scored = (base if best is not None and best.mean_score >= floor else base.limit(0)), False
        topics = heads.select(F.explode("topics").alias("t"), "generated_at").select("t.id", "t.topic", "generated_at")
        read = retrieval.structured_read(hits, asked, topics, scored)
        rows = read.join(self.memories.select("id", "content", "valid_from", "confidence", "source_agent"), "id", "left").orderBy("rank").collect()
        facts = [{"memory_id": r.id, "fact": r.content, "topic": r.topic, "as_of": r.valid_from, "confidence": r.confidence, "source_agent": r.source_agent} for r in rows if r.id is not None]
        self._log("memory_read", len(query), len(facts))
        return Reading(own, echo, facts, rows[0].abstain, rows[0].top_relevance, status, told)

    def memory_write(self, boundaries: list[str], content: str, boundary: str, memory_type: str = "semantic", confidence: float = DEFAULT_CONFIDENCE, source_agent: str | None = None) -> str:
        """Saves a fact in its canonical form and returns its id."""
        if boundary not in boundaries:
            raise AccessDenied("boundary is outside the caller's scope")
        if memory_type not in MEMORY_TYPES:
            raise InvalidInput("unknown memory type")
        now = self.now()
        row = (time_ordered_id(now), content, memory_type, source_agent, boundary, now, now, None, float(confidence), 0, now, None, None, "{}")
        rows = canonical_form(self.spark.createDataFrame([row], schema("memories")), "content", "saved").withColumn("content", F.coalesce("saved", F.lit(""))).drop("saved")
        saved = validate_memories(rows).first()
        if saved.violations:
            raise InvalidInput(", ".join(saved.violations))
        vector = self.spark.createDataFrame([(row[0], [float(x) for x in self.embed([saved.content])[0]], boundary)], schema("vectors"))
        self._replace("memories", self.memories.unionByName(rows.select(*self.memories.columns)))
        self._replace("vectors", tables.upsert(self.vectors, vector, ["id"]))
        self._reindex(row[0])
        self._audit("memory.create", row[0], boundary)
        self._log("memory_write", len(content), 1)
        return row[0]

    def _stored(self, key: str) -> str | None:
        """The scope a fact is stored in."""
        found = scope.get(self.memories, key).select("boundary").first()
        return None if found is None else found.boundary

    def memory_update(self, boundaries: list[str], key: str, content: str) -> None:
        """New content for a fact; other fields stay, an archived fact comes back."""
        stored = self._stored(key)
        if stored is None:
            raise NotFound("no such fact")
        if stored not in boundaries:
            raise AccessDenied("fact is outside the caller's scope")
        edit = canonical_form(self.spark.createDataFrame([(key, content)], "id string, content string"), "content", "saved").first().saved
        if edit is None:
            raise InvalidInput("content_empty")
        none = F.lit(None)
        change = self.spark.createDataFrame([(key, edit)], "id string, content string").select("id", "content", none.cast("string").alias("memory_type"), none.cast("string").alias("boundary"), none.cast("float").alias("confidence"))
        vector = self.spark.createDataFrame([(key, [float(x) for x in self.embed([edit])[0]], stored)], schema("vectors"))
        self._replace("memories", tables.edit_memory(self.memories, change, self._at()))
        self._replace("vectors", tables.upsert(self.vectors, vector, ["id"]))
        self._reindex(key)
        self._audit("memory.update", key, stored)
        self._log("memory_update", len(content), 1)

    def memory_delete(self, boundaries: list[str], key: str) -> bool:
        """True if there was a fact to delete; a missing one is no error."""
        stored = self._stored(key)
        if stored is not None and stored not in boundaries:
            raise AccessDenied("fact is outside the caller's scope")
        if stored is not None:
            gone = self.spark.createDataFrame([(key,)], "id string")
            self._replace("memories", tables.delete(self.memories, gone))
            self._replace("vectors", tables.delete(self.vectors, gone))
            self._reindex(key)
            self._audit("memory.delete", key, stored)
        self._log("memory_delete", len(key), int(stored is not None))
        return stored is not None
