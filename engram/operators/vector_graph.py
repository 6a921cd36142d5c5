"""Vector index of navigable graphs over 8-bit codes, one graph a shard, with exact rescoring.

A shard holds up to about ``SHARD_VECTORS`` vectors of one scope: a byte a number, scaled to the
shard's range in that dimension, and for every vector links to its nearest ones and to some that
have it among theirs. A search reads codes and links only. It walks each shard from a few
entries, all queries of a block together: the best vector not yet left is left for those it
links to, and a list of the best ``ef`` is kept until none of them is left to leave. The
candidates of all shards are scored again with the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from engram.operators.knn import QUERY_BLOCK, SCORED, _matrix, _unit
from engram.sources.shared import materialise

SHARD_VECTORS = 16_384
LINKS = 24
ENTRIES = 16
EF = 96
#: Queries that walk together, so that codes they gather stay within some 100 MB.
TOGETHER = 256
#: Vectors whose links are looked for at once, so that their scores against a shard and the order of these take some 80 MB.
LINKED = 128
SHARD_SCHEMA = "boundary string, dim int, ids array<string>, low binary, step binary, codes binary, links binary"


@dataclass(frozen=True)
class GraphIndex:
    """``shards``: a row a shard. Vectors of another dimension than ``dim`` are not in it."""

    shards: DataFrame
    dim: int


def codes_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A byte a number, and each dimension's least value and step."""
    low = x.min(axis=0)
    step = np.maximum((x.max(axis=0) - low) / 255, 1e-12)
    return np.clip(np.rint((x - low) / step), 0, 255).astype(np.uint8), low.astype(np.float32), step.astype(np.float32)


def links_of(x: np.ndarray, most: int = LINKS) -> np.ndarray:
    """Each row's nearest others in half of its places; in the rest the first that have it among theirs, or -1.

    Of equal vectors the lower places would take all links: a vector's own place is rotated to
    the front of the order of ties.
    """
    n = len(x)
    half = max(1, min(most // 2, n - 1))
    out = np.full((n, most), -1, dtype=np.int32)
    if n == 1:
        return out
    for lo in range(0, n, LINKED):
        scores = x[lo : lo + LINKED] @ x.T
        own = np.arange(lo, min(lo + LINKED, n))
        scores -= 1e-9 * ((np.arange(n)[None, :] - own[:, None]) % n)
        scores[np.arange(len(own)), own] = -np.inf
        near = np.argpartition(-scores, half - 1, axis=1)[:, :half] if half < n - 1 else np.argsort(-scores, axis=1)[:, :half]
        out[lo : lo + len(own), :half] = near
    source, target = np.repeat(np.arange(n), half), out[:, :half].ravel()
    new = ~(out[target, :half] == source[:, None]).any(axis=1)
    source, target = source[new], target[new]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    turn = np.arange(len(target)) - np.searchsorted(target, target)
    some = turn < most - half
    out[target[some], half + turn[some]] = source[some]
    return out


def build(vectors: DataFrame) -> GraphIndex:
    """The index of all vectors of the commonest dimension, written to shared storage; null vectors are left out.

    Scopes are dealt into shards by a hash of the id, as many as each needs.
    """
    sized = vectors.where("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = 0 if sized is None else sized["dim"]
    return GraphIndex(_shards(vectors, dim), dim)


def _shards(vectors: DataFrame, dim: int) -> DataFrame:
    base = vectors.where(F.size("embedding") == dim).select("boundary", "id", "embedding")
    counts = base.groupBy(F.col("boundary").alias("_scope")).agg(F.ceil(F.count(F.lit(1)) / SHARD_VECTORS).cast("int").alias("n"))
    dealt = base.join(counts, F.col("boundary").eqNullSafe(F.col("_scope"))).select("boundary", "id", "embedding", F.pmod(F.xxhash64("id"), F.col("n")).alias("block"))

    def make(rows: pa.Table) -> pa.Table:
        x = _unit(_matrix(rows.column("embedding"))).astype(np.float32)
        codes, low, step = codes_of(x)
        one = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.table(
            [rows.column("boundary").slice(0, 1).combine_chunks(), pa.array([x.shape[1]], pa.int32()), pa.array([rows.column("id").to_pylist()], pa.list_(pa.string())), one(low), one(step), one(codes), one(links_of(x))],
            names=["boundary", "dim", "ids", "low", "step", "codes", "links"],
        )

    return materialise(dealt.groupBy("boundary", "block").applyInArrow(make, SHARD_SCHEMA), "graph-shards")


def upsert(index: GraphIndex, changed: DataFrame) -> GraphIndex:
    """Shards of ``changed`` vectors beside the old ones.

    Old codes stay: what a search returns is scored by the vectors it is given, so removed ids
    drop out there and changed ones have their new score. ``build`` again once many have gone.
    """
    return GraphIndex(index.shards.unionByName(_shards(changed, index.dim)), index.dim)


def walk(codes: np.ndarray, links: np.ndarray, low: np.ndarray, step: np.ndarray, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of each query's best ``ef`` vectors that its walk has met; -1 for none."""
    n, asked = len(codes), len(q)
    scaled, base = (q * step).astype(np.float32), (q @ low).astype(np.float32)
    entries = np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(np.int64))
    met = np.zeros((asked, n), dtype=bool)
    met[:, entries] = True
    scores = scaled @ codes[entries].astype(np.float32).T + base[:, None]
    places = np.broadcast_to(entries, scores.shape).copy()
    pad = ef - len(entries)
    if pad > 0:
        places = np.pad(places, ((0, 0), (0, pad)), constant_values=-1)
        scores = np.pad(scores, ((0, 0), (0, pad)), constant_values=-np.inf)
    left = places < 0
    rows = np.arange(asked)
    while len(rows):
        open_scores = np.where(left[rows], -np.inf, scores[rows])
        at = open_scores.argmax(axis=1)
        going = open_scores[np.arange(len(rows)), at] > -np.inf
        rows, at = rows[going], at[going]
        if not len(rows):
            break
        left[rows, at] = True
        near = links[places[rows, at]]
        fresh = (near >= 0) & ~met[rows[:, None], near]
        safe = np.where(fresh, near, 0)
        met[rows[:, None], np.where(fresh, near, places[rows, at][:, None])] = True
        found = np.matmul(codes[safe].astype(np.float32), scaled[rows][:, :, None])[:, :, 0] + base[rows][:, None]
        all_scores = np.concatenate((scores[rows], np.where(fresh, found, -np.inf)), axis=1)
        all_places = np.concatenate((places[rows], np.where(fresh, near, -1)), axis=1)
        all_left = np.concatenate((left[rows], ~fresh), axis=1)
        top = np.argpartition(-all_scores, ef - 1, axis=1)[:, :ef]
        scores[rows], places[rows], left[rows] = (np.take_along_axis(a, top, axis=1) for a in (all_scores, all_places, all_left))
    return places, scores


def candidates(queries: DataFrame, index: GraphIndex, ef: int = EF) -> DataFrame:
    """``query_id, id``: what each query's walks through the shards of its scopes have found.

    Queries go in blocks of ``QUERY_BLOCK`` to every shard. A query without a vector, or of
    another dimension than the index, finds nothing.
    """
    spark = index.shards.sparkSession
    kind = queries.schema["query_id"].dataType
    arrow, found = to_arrow_type(kind), None

    def block(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r.query_id for r in rows], _unit(np.array([r.embedding for r in rows], dtype=np.float64)), [frozenset(r.scopes or ()) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, scopes = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = {c: batch.column(c)[i] for c in batch.schema.names}
                    own = np.array([j for j, s in enumerate(scopes) if shard["boundary"].as_py() in s], dtype=np.int64)
                    dim, ids = shard["dim"].as_py(), shard["ids"].as_py()
                    as_array = lambda c, t: np.frombuffer(shard[c].as_buffer(), dtype=t)
                    codes, links = as_array("codes", np.uint8).reshape(-1, dim), as_array("links", np.int32).reshape(len(ids), -1)
                    for lo in range(0, len(own), TOGETHER):
                        some = own[lo : lo + TOGETHER]
                        places, _ = walk(codes, links, as_array("low", np.float32), as_array("step", np.float32), q[some], ef)
                        who, at = np.nonzero(places >= 0)
                        yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in some[who].tolist()], arrow), pa.array([ids[p] for p in places[who, at].tolist()], pa.string())], names=["query_id", "id"])

        return index.shards.mapInArrow(run, f"query_id {kind.simpleString()}, id string")

    rows: list = []
    for r in queries.where(F.size("embedding") == index.dim).select("query_id", "embedding", "scopes").toLocalIterator():
        rows.append(r)
        if len(rows) == QUERY_BLOCK:
            found = block(rows) if found is None else found.unionByName(block(rows))
            rows = []
    if rows:
        found = block(rows) if found is None else found.unionByName(block(rows))
    return spark.createDataFrame([], f"query_id {kind.simpleString()}, id string") if found is None else found


def search(queries: DataFrame, index: GraphIndex, vectors: DataFrame, k: int, ef: int = EF) -> DataFrame:
    """``query_id, id, score, rank`` as ``knn.knn`` gives it, among the candidates of the walks.

    ``vectors`` are the vectors as they are now; candidates meet them by id, are held against the
    query's scopes again and are scored exactly. Ties go to the lower id.
    """
    asked = queries.select("query_id", F.col("embedding").alias("asked"), "scopes")
    met = candidates(queries, index, ef).distinct().join(vectors.select("id", "embedding", "boundary"), "id").join(asked, "query_id").where(F.array_contains("scopes", F.col("boundary")))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, SCORED) for whole in batches for lo in range(0, whole.num_rows, SCORED)):
            v, q = _unit(_matrix(batch.column("embedding"))), _unit(_matrix(batch.column("asked")))
            scores = (v * q).sum(axis=1) if v.shape == q.shape else np.zeros(len(v))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(scores)], names=["query_id", "id", "score"])

    scored = met.select("query_id", "id", "embedding", "asked").mapInArrow(score, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
