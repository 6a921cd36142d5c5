"""Exact vector search and k-nearest-neighbour joins on numpy blocks.

A search broadcasts its queries in blocks of at most ``QUERY_BLOCK`` rows. Each partition of
the vector table keeps its own best k of every query, so what crosses the shuffle is at most
k rows a query and partition. A self-join deals each scope's vectors into blocks of about
``JOIN_BLOCK`` rows, as many as that scope needs, and compares each two blocks once; no task
holds more than two blocks. Where only some vectors look for neighbours, they are dealt into
blocks of their own, so that the others are sent once for each of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

QUERY_BLOCK = 2048
JOIN_BLOCK = 4096
#: Vectors scored at once, so that the scores of a block of queries take some 16 MB.
SCORED = 1024
LEAST_NORM = 1e-12


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of doubles; rows of another length than the first are zero."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(flat) and not flat.null_count:
        sizes = np.diff(flat.offsets.to_numpy())
        values = flat.flatten()
        if (sizes == sizes[0]).all() and sizes[0] and not values.null_count:
            return values.to_numpy().reshape(len(flat), sizes[0]).astype(np.float64)
    rows = column.to_pylist()
    dim = next((len(r) for r in rows if r), 0)
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        if r is not None and len(r) == dim:
            out[i] = r
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), LEAST_NORM)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best scores, ties by id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(scores))
    order = np.lexsort((ids[some], -scores[some]))
    return some[order[:k]]


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` most similar vectors of each query in its scopes.

    ``queries`` has ``query_id, embedding, scopes`` (array; an empty one finds nothing). The
    scope is applied before the cut to ``k``. Ties go to the lower id. Vectors of another
    dimension than the query's score 0. A query without a vector finds nothing.
    """
    session = vectors.sparkSession
    arrow = to_arrow_type(queries.schema["query_id"].dataType)
    found = None
    rows: list = []

    def search(block: list) -> DataFrame:
        names = [r.query_id for r in block]
        dim = max((len(r.embedding) for r in block), default=0)
        q = np.zeros((len(block), dim))
        for i, r in enumerate(block):
            if len(r.embedding) == dim:
                q[i] = r.embedding
        shared = session.sparkContext.broadcast((names, _unit(q), [frozenset(r.scopes or ()) for r in block]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, scopes = shared.value
            kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=object), np.zeros(0))] * len(names)
            for batch in (whole.slice(lo, SCORED) for whole in batches for lo in range(0, whole.num_rows, SCORED)):
                v = _matrix(batch.column("embedding"))
                v = _unit(v) if v.shape[1] == q.shape[1] else np.zeros((len(v), q.shape[1]))
                ids = np.array(batch.column("id").to_pylist(), dtype=object)
                where = np.array(batch.column("boundary").to_pylist(), dtype=object)
                scores = q @ v.T
                masks = {s: np.isin(where, list(s)) if s else np.zeros(len(where), dtype=bool) for s in set(scopes)}
                for i in range(len(names)):
                    at = np.flatnonzero(masks[scopes[i]])
                    all_ids, all_scores = np.concatenate((kept[i][0], ids[at])), np.concatenate((kept[i][1], scores[i, at]))
                    top = _best(all_scores, all_ids, k)
                    kept[i] = (all_ids[top], all_scores[top])
            n = [len(x[0]) for x in kept]
            if sum(n):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in range(len(n)) for _ in range(n[i])], arrow), pa.array(np.concatenate([x[0] for x in kept]).tolist()), pa.array(np.concatenate([x[1] for x in kept]))],
                    names=["query_id", "id", "score"],
                )

        kind = queries.schema["query_id"].dataType.simpleString()
        return vectors.select("id", "embedding", "boundary").mapInArrow(run, f"query_id {kind}, id string, score double")

    for r in queries.where("embedding is not null").select("query_id", "embedding", "scopes").toLocalIterator():
        rows.append(r)
        if len(rows) == QUERY_BLOCK:
            found = search(rows) if found is None else found.union(search(rows))
            rows = []
    if rows or found is None:
        found = search(rows) if found is None else found.union(search(rows))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, k: int, floor: float, seeds: DataFrame | None = None) -> DataFrame:
    """``boundary, id, other, score``: up to ``k`` other vectors of the same scope with cosine >= ``floor``.

    With ``seeds`` (column ``id``) only those vectors look for neighbours. Ties go to the
    lower id. Every pair of a scope is compared, block by block.
    """
    base = vectors.select("boundary", "id", "embedding")
    looking = base if seeds is None else base.join(seeds.select("id"), "id", "left_semi").select(*base.columns)

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        """How many blocks each scope of ``rows`` has."""
        return rows.groupBy("boundary").agg(F.ceil(F.count(F.lit(1)) / JOIN_BLOCK).cast("int").alias(name))

    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    if seeds is None:
        placed = base.join(blocks(base, "n"), "boundary").withColumn("block", dealt("n"))
        left = placed.select(*base.columns, F.col("block").alias("lb"), F.explode(F.sequence("block", F.col("n") - 1)).alias("rb"))
        # Own attributes for the right side, as both sides come from the same rows; a block meets itself on the left alone.
        others = placed.where("block > 0").select(*[F.col(c).alias(c) for c in base.columns], F.col("block").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("lb"))
    else:
        counts = blocks(looking, "ln").join(blocks(base, "rn"), "boundary")
        left = looking.join(counts, "boundary").withColumn("lb", dealt("ln")).select(*base.columns, "lb", F.explode(F.sequence(F.lit(0), F.col("rn") - 1)).alias("rb"))
        others = base.join(counts, "boundary").withColumn("rb", dealt("rn")).select(*[F.col(c).alias(c) for c in base.columns], "rb", F.explode(F.sequence(F.lit(0), F.col("ln") - 1)).alias("lb"))
    one_way = seeds is not None

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {"boundary": [], "id": [], "other": [], "score": []}

        def best(x: np.ndarray, own: np.ndarray, y: np.ndarray, other: np.ndarray) -> None:
            for lo in range(0, len(own), 512):
                scores = x[lo : lo + 512] @ y.T
                for i, me in enumerate(own[lo : lo + 512]):
                    at = np.flatnonzero((scores[i] >= floor) & (other != me))
                    at = at[_best(scores[i][at], other[at], k)]
                    out["boundary"] += [scope] * len(at)
                    out["id"] += [me] * len(at)
                    out["other"] += other[at].tolist()
                    out["score"] += scores[i][at].tolist()

        if a.num_rows:
            scope = a.column("boundary")[0].as_py()
            x, ids = _unit(_matrix(a.column("embedding"))), np.array(a.column("id").to_pylist(), dtype=object)
            if not one_way and a.column("lb")[0].as_py() == a.column("rb")[0].as_py():
                best(x, ids, x, ids)
            elif b.num_rows:
                y, others = _unit(_matrix(b.column("embedding"))), np.array(b.column("id").to_pylist(), dtype=object)
                if x.shape[1] == y.shape[1]:
                    best(x, ids, y, others)
                    if not one_way:
                        best(y, others, x, ids)
        return pa.table({"boundary": pa.array(out["boundary"], pa.string()), "id": pa.array(out["id"], pa.string()), "other": pa.array(out["other"], pa.string()), "score": pa.array(out["score"], pa.float64())})

    keys = ["boundary", "lb", "rb"]
    part = left.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(compare, "boundary string, id string, other string, score double")
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "other")
    return part.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= k).drop("_turn")


def edges(found: DataFrame) -> DataFrame:
    """Neighbour rows as distinct pairs ``a < b``."""
    return found.select("boundary", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def mutual(found: DataFrame) -> DataFrame:
    """Distinct pairs that are neighbours of each other both ways."""
    back = found.select("boundary", F.col("other").alias("id"), F.col("id").alias("other"))
    return edges(found.join(back, ["boundary", "id", "other"], "left_semi"))
