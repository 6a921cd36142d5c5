"""Retrievers and stores as objects, so that a caller can swap one for another.

A retriever answers a batch: ``queries`` (``query_id, text, embedding, scopes``) in,
``query_id, id, score, rank`` out. Queries that ``retrieval.query_fault`` names get no row.
Stores hold DataFrames and never change in place: a write returns the next store.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators import bm25, graph, retrieval, scope
from engram.operators.knn import knn
from engram.sources import tables
from engram.sources.schema import quarantine, validate_vectors

RESULT = ["query_id", "id", "score", "rank"]


class Retriever(Protocol):
    def retrieve(self, queries: DataFrame, max_results: int) -> DataFrame: ...


class ReportLoader(Protocol):
    def __call__(self) -> DataFrame: ...


@dataclass(frozen=True)
class SemanticRetriever:
    vectors: DataFrame
    memories: DataFrame
    now: Column
    threshold: float | None = None
    include_archived: bool = False

    def retrieve(self, queries: DataFrame, max_results: int) -> DataFrame:
        retrieval.check_page(max_results)
        return retrieval.semantic(retrieval.sound_queries(queries), self.vectors, self.memories, self.now, max_results, self.threshold, self.include_archived).select(*RESULT)


@dataclass(frozen=True)
class KeywordRetriever:
    index: bm25.KeywordIndex
    memories: DataFrame
    now: Column

    def retrieve(self, queries: DataFrame, max_results: int) -> DataFrame:
        retrieval.check_page(max_results)
        return retrieval.keyword(retrieval.sound_queries(queries, to_embed=False), self.index, self.memories, self.now, max_results).select(*RESULT)


@dataclass(frozen=True)
class HybridRetriever:
    vectors: DataFrame
    index: bm25.KeywordIndex
    memories: DataFrame
    now: Column
    threshold: float | None = None

    def retrieve(self, queries: DataFrame, max_results: int) -> DataFrame:
        retrieval.check_page(max_results)
        return retrieval.hybrid(retrieval.sound_queries(queries), self.vectors, self.index, self.memories, self.now, max_results, self.threshold).select(*RESULT)


@dataclass(frozen=True)
class AbstainingRetriever:
    """The inner retriever's results where the keywords match well enough, else nothing."""

    inner: Retriever
    index: bm25.KeywordIndex
    least: float = retrieval.ABSTAIN_BELOW

    def retrieve(self, queries: DataFrame, max_results: int) -> DataFrame:
        return retrieval.abstaining(self.inner.retrieve(queries, max_results), retrieval.sound_queries(queries, to_embed=False), self.index, self.least)


@dataclass(frozen=True)
class GraphRetriever:
    memories: DataFrame
    entities: DataFrame
    relationships: DataFrame

    def retrieve(self, queries: DataFrame, max_results: int) -> DataFrame:
        retrieval.check_page(max_results)
        return graph.retrieve_graph(retrieval.sound_queries(queries, to_embed=False), self.memories, self.entities, self.relationships, max_results).select(*RESULT)


@dataclass(frozen=True)
class RerankedRetriever:
    """Base, semantic and graph hits as one pool, by ``logits(queries, candidates)``.

    ``logits`` returns ``query_id, id, logit``, or None where the model is not there; then
    the pool keeps its order.
    """

    base: Retriever
    near: Retriever
    around: Retriever
    logits: Callable[[DataFrame, DataFrame], DataFrame | None]
    threshold: float | None = None

    def retrieve(self, queries: DataFrame, max_results: int) -> DataFrame:
        retrieval.check_page(max_results)
        pooled = retrieval.pool(*[r.retrieve(queries, retrieval.FANOUT) for r in (self.base, self.near, self.around)])
        told = self.logits(queries, retrieval.scored_part(pooled))
        return retrieval.reranked(pooled, told, max_results, self.threshold).select(*RESULT)


@dataclass(frozen=True)
class VectorStore:
    """``rows``: ``id, embedding, boundary``, vectors of ``dim`` numbers."""

    rows: DataFrame
    dim: int

    def upsert(self, vectors: DataFrame) -> VectorStore:
        """All or nothing: one vector that breaks a rule and none is written."""
        judged = validate_vectors(vectors, self.dim)
        if not (bad := quarantine(judged)[1]).isEmpty():
            names = bad.select(F.explode("violations").alias("v")).distinct().orderBy("v").collect()
            raise ValueError("vectors refused: " + ", ".join(r.v for r in names))
        return replace(self, rows=tables.upsert(self.rows, vectors.select(*self.rows.columns), ["id"]))

    def delete(self, ids: DataFrame) -> VectorStore:
        return replace(self, rows=tables.delete(self.rows, ids.select("id")))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return knn(queries, self.rows, k)

    def count(self, boundaries: list[str] | None = None) -> int:
        return (self.rows if boundaries is None else self.rows.where(scope.in_scope(boundaries))).count()

    def contains(self, ids: DataFrame) -> DataFrame:
        """``id, there`` for each id asked about."""
        known = self.rows.select("id").distinct().withColumn("there", F.lit(True))
        return ids.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("there", F.lit(False)).alias("there"))


@dataclass(frozen=True)
class GraphStore:
    entities: DataFrame
    relationships: DataFrame

    def add_entities(self, rows: DataFrame) -> tuple[GraphStore, DataFrame]:
        """The next store and the refused rows."""
        good, refused = tables.new_entities(self.entities, rows)
        return replace(self, entities=self.entities.unionByName(good.select(*self.entities.columns))), refused

    def add_relationships(self, rows: DataFrame) -> tuple[GraphStore, DataFrame]:
        good, refused = tables.new_relationships(self.entities, rows)
        return replace(self, relationships=self.relationships.unionByName(good.select(*self.relationships.columns))), refused

    def supersede(self, changes: DataFrame) -> tuple[GraphStore, DataFrame]:
        closed, refused = tables.supersede_relationships(self.relationships, changes)
        return replace(self, relationships=closed), refused

    def retire(self, memory_ids: DataFrame, now: Column) -> GraphStore:
        return replace(self, relationships=tables.retire_edges(self.relationships, memory_ids, now).drop("retired"))

    def in_scope(self, boundaries: list[str]) -> DataFrame:
        return graph.list_entities(self.entities, boundaries)

    def by_key(self, name: str, entity_type: str, boundary: str) -> DataFrame:
        return graph.entity_by_key(self.entities, name, entity_type, boundary)

    def neighbourhood(self, nodes: DataFrame, boundaries: list[str] | None = None) -> DataFrame:
        return graph.neighbourhood(self.relationships, nodes, boundaries)

    def traverse(self, starts: DataFrame, boundaries: list[str] | None = None, max_hops: int = graph.MAX_HOPS) -> DataFrame:
        return graph.traverse(self.relationships, self.entities, starts, boundaries, max_hops)
