"""Vector index by cells, and a neighbour join that compares within cells only.

Centres come from k-means on a bounded sample. Every vector is stored with the cell of its
nearest centre, in one folder a cell, so that a search reads only the folders of the cells that
its queries probe. How many cells a query probes is measured on the sample when the index is
fitted. An exact search goes on to every cell that may still hold a better vector than the last
one found, by the angle between query and centre and the cell's widest angle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from engram.operators.knn import JOIN_BLOCK, QUERY_BLOCK, _best, _matrix, _unit
from engram.sources.shared import materialise, shared_path

MOST_CELLS = 4096
#: The sample of a fit: vectors a cell, and numbers in all (64 MB).
SAMPLE_PER_CELL = 64
SAMPLE_NUMBERS = 8 << 20
ROUNDS = 10
#: Vectors of the sample that probe for their neighbours, how many neighbours, and the share of them to be found.
PROBING = 256
NEAREST = 10
WANTED = 0.95
#: The cell of vectors of another dimension than the centres'; every search reads it.
ODD = -1
SLACK = 1e-9


@dataclass(frozen=True)
class Centres:
    """Unit centres as rows, and the number of cells in which ``WANTED`` of the nearest vectors lie."""

    points: np.ndarray
    probes: int

    def nearest(self, unit: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` nearest cells of each row, nearest first."""
        scores = unit @ self.points.T
        if most < scores.shape[1]:
            some = np.argpartition(-scores, most - 1, axis=1)[:, :most]
            order = np.argsort(-np.take_along_axis(scores, some, axis=1), axis=1, kind="stable")
            return np.take_along_axis(some, order, axis=1)
        return np.argsort(-scores, axis=1, kind="stable")


@dataclass(frozen=True)
class CellIndex:
    """``rows``: id, embedding, boundary, cell. ``least`` has each cell's least cosine to its centre."""

    rows: DataFrame
    centres: Centres
    least: dict[int, float]


def fit_centres(vectors: DataFrame, cells: int | None = None) -> Centres:
    """Spherical k-means on a sample of ``SAMPLE_PER_CELL`` vectors a cell, ``SAMPLE_NUMBERS`` numbers at most.

    The sample is drawn by a hash of the id. Without ``cells`` there are about as many as the
    root of the number of vectors. Null vectors are left out; the commonest dimension counts.
    """
    sized = vectors.where("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sized is None:
        return Centres(np.zeros((1, 1)), 1)
    dim, n = sized["dim"], sized["count"]
    cells = max(1, min(round(math.sqrt(n)) if cells is None else cells, MOST_CELLS, n))
    most = max(min(SAMPLE_PER_CELL * cells, SAMPLE_NUMBERS // dim), 1)
    drawn = vectors.where((F.size("embedding") == dim) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < math.ceil(most / n * (1 << 30))))
    # Ids may repeat, so the hash alone bounds nothing.
    x = _unit(_matrix(drawn.select("embedding").limit(2 * most).toArrow().column(0)))
    if not len(x):
        x = _unit(_matrix(vectors.where(F.size("embedding") == dim).select("embedding").limit(1).toArrow().column(0)))
    points = np.unique(x, axis=0)
    points = points[np.random.default_rng(7).permutation(len(points))[:cells]]
    for _ in range(ROUNDS):
        home = (x @ points.T).argmax(axis=1)
        sums = np.zeros_like(points)
        np.add.at(sums, home, x)
        filled = np.abs(sums).sum(axis=1) > 0
        points[filled] = _unit(sums[filled])
    centres = Centres(points, len(points))
    return replace(centres, probes=_probes(centres, x))


def _probes(centres: Centres, x: np.ndarray) -> int:
    """The fewest cells in which ``WANTED`` of the sample's nearest vectors are found."""
    asked = x[:PROBING]
    scores = asked @ x.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(NEAREST, len(x) - 1)
    if not k:
        return len(centres.points)
    home = (x @ centres.points.T).argmax(axis=1)
    turn = np.empty((len(asked), len(centres.points)), dtype=np.int64)
    np.put_along_axis(turn, centres.nearest(asked, len(centres.points)), np.arange(len(centres.points))[None, :], axis=1)
    turns = np.take_along_axis(turn, home[np.argpartition(-scores, k - 1, axis=1)[:, :k]], axis=1).ravel()
    return int(np.sort(turns)[min(math.ceil(WANTED * len(turns)), len(turns)) - 1]) + 1


def placed(vectors: DataFrame, centres: Centres, visits: int = 1) -> DataFrame:
    """``vectors`` with ``cells`` (the ``visits`` nearest, nearest first) and ``cosine`` to the first centre.

    Vectors of another dimension, null ones too, are in the cell ``ODD`` alone.
    """
    schema = T.StructType([*vectors.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("cosine", T.DoubleType())])
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        dim = centres.points.shape[1]
        for batch in batches:
            lists = batch.column("embedding")
            fits = np.array([x is not None and len(x) == dim and None not in x for x in lists.to_pylist()], dtype=bool)
            cells: list[list[int]] = [[ODD]] * len(fits)
            cosines = np.zeros(len(fits))
            at = np.flatnonzero(fits)
            if len(at):
                x = _unit(_matrix(lists.take(pa.array(at))))
                near = centres.nearest(x, min(visits, len(centres.points)))
                cosines[at] = (x * centres.points[near[:, 0]]).sum(axis=1)
                for i, c in zip(at.tolist(), near.tolist()):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32())), pa.array(cosines)], names=schema.names)

    return vectors.mapInArrow(run, schema)


def _written(vectors: DataFrame, centres: Centres) -> tuple[DataFrame, dict[int, float]]:
    """Rows in folders by cell, and each cell's least cosine. A large cell is dealt into several files by id."""
    found = placed(vectors.select("id", "embedding", "boundary"), centres)
    path = shared_path(vectors.sparkSession, "cells")
    dealt = found.select("id", "embedding", "boundary", "cosine", F.col("cells")[0].alias("cell")).repartitionByRange("cell", "id")
    dealt.write.partitionBy("cell").option("compression", "zstd").parquet(path)
    schema = T.StructType([*dealt.drop("cell").schema.fields, T.StructField("cell", T.IntegerType())])
    rows = vectors.sparkSession.read.schema(schema).parquet(path)
    least = {r.cell: r.least for r in rows.groupBy("cell").agg(F.min("cosine").alias("least")).collect()}  # one row a cell
    return rows.drop("cosine"), least


def build(vectors: DataFrame, centres: Centres | None = None) -> CellIndex:
    """The index of all ``vectors``, written to shared storage; fitted on their sample unless ``centres`` are given."""
    centres = centres or fit_centres(vectors)
    rows, least = _written(vectors, centres)
    return CellIndex(rows, centres, least)


def upsert(index: CellIndex, changed: DataFrame, deleted: DataFrame) -> CellIndex:
    """The index after ``changed`` vectors were written again and ``deleted`` ids removed.

    New vectors are written by cell beside the old ones, which stay as they are; ids that were
    written again or removed leave the old rows when they are read. ``compacted`` writes all anew.
    """
    gone = materialise(changed.select("id").unionByName(deleted.select("id")).distinct(), "cells-gone")
    rows, least = _written(changed, index.centres)
    both = {c: min(index.least.get(c, 1.0), least.get(c, 1.0)) for c in {*index.least, *least}}
    return CellIndex(index.rows.join(gone, "id", "left_anti").select(*rows.columns).unionByName(rows), index.centres, both)


def compacted(index: CellIndex) -> CellIndex:
    """The same rows in one set of folders under centres fitted again."""
    return build(index.rows.drop("cell"))


def search(queries: DataFrame, index: CellIndex, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """``query_id, id, score, rank`` as ``knn.knn`` gives it, from the nearest ``probes`` cells of each query.

    ``exact`` goes on to all cells that may hold a better vector, so that nothing is missed.
    Queries of another dimension than the centres' read every cell.
    """
    spark = index.rows.sparkSession
    probes = index.centres.probes if probes is None else probes
    name_type = queries.schema["query_id"].dataType
    known = np.array(sorted(c for c in index.least if c != ODD), dtype=np.int64)
    dim = index.centres.points.shape[1]
    parts: list[DataFrame] = []

    def block(rows: list) -> None:
        fits = np.array([len(r.embedding) == dim for r in rows])
        q = np.zeros((len(rows), max(len(r.embedding) for r in rows)))
        for i, r in enumerate(rows):
            q[i, : len(r.embedding)] = r.embedding
        unit = _unit(q)
        inner = unit[:, :dim] if unit.shape[1] >= dim else np.zeros((len(rows), dim))
        near = index.centres.nearest(inner, min(probes, len(index.centres.points)))
        first = [set(near[i].tolist()) & set(known.tolist()) if fits[i] else set(known.tolist()) for i in range(len(rows))]
        found = _scan(index, rows, unit, [c | {ODD} for c in first], k, name_type)
        parts.append(found)
        if exact:
            parts[-1] = found = materialise(found, "cells-first")
            w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
            last = {r.query_id: r.score for r in found.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") == k).collect()}  # one row a query of the block
            angle = np.arccos(np.clip(inner @ index.centres.points[known].T, -1, 1))
            wide = np.arccos(np.clip([index.least[c] for c in known.tolist()], -1, 1))
            bound = np.cos(np.maximum(angle - wide, 0)) + SLACK
            more = [set(known[bound[i] >= last.get(r.query_id, -2)].tolist()) - first[i] for i, r in enumerate(rows)]
            if any(more):
                parts.append(_scan(index, rows, unit, more, k, name_type))

    rows: list = []
    for r in queries.where("embedding is not null").select("query_id", "embedding", "scopes").toLocalIterator():
        rows.append(r)
        if len(rows) == QUERY_BLOCK:
            block(rows)
            rows = []
    if rows:
        block(rows)
    whole = parts[0] if parts else spark.createDataFrame([], f"query_id {name_type.simpleString()}, id string, score double")
    for part in parts[1:]:
        whole = whole.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return whole.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scan(index: CellIndex, rows: list, unit: np.ndarray, cells: list[set[int]], k: int, name_type: T.DataType) -> DataFrame:
    """Each partition's best ``k`` of every query, from the cells that the query reads."""
    asking: dict[int, list[int]] = {}
    for i, own in enumerate(cells):
        for c in own:
            asking.setdefault(c, []).append(i)
    asking = {c: np.array(i) for c, i in asking.items()}
    sizes = np.array([len(r.embedding) for r in rows])
    shared = index.rows.sparkSession.sparkContext.broadcast(([r.query_id for r in rows], unit, sizes, [frozenset(r.scopes or ()) for r in rows], asking))
    arrow = to_arrow_type(name_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, sizes, scopes, asking = shared.value
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            where, cell = np.array(batch.column("boundary").to_pylist(), dtype=object), batch.column("cell").to_numpy()
            ids = np.array(batch.column("id").to_pylist(), dtype=object)
            lists = batch.column("embedding")
            # Vectors of one cell have one length, but for those of the odd cell.
            sizes_of = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            for c, width in np.unique(np.stack((cell, np.where(cell == ODD, sizes_of, 0)), axis=1), axis=0).tolist():
                at = np.flatnonzero((cell == c) & ((c != ODD) | (sizes_of == width)))
                own = asking.get(c)
                if own is None:
                    continue
                v = _matrix(lists.take(pa.array(at)))
                width = v.shape[1]
                scores = q[own, :width] @ _unit(v).T if width <= q.shape[1] else np.zeros((len(own), len(at)))
                scores[sizes[own] != width] = 0
                masks = {s: np.isin(where[at], list(s)) if s else np.zeros(len(at), dtype=bool) for s in {scopes[i] for i in own.tolist()}}
                for row, i in enumerate(own.tolist()):
                    some = np.flatnonzero(masks[scopes[i]])
                    old = kept.get(i)
                    all_ids, all_scores = ids[at[some]], scores[row, some]
                    if old is not None:
                        all_ids, all_scores = np.concatenate((old[0], all_ids)), np.concatenate((old[1], all_scores))
                    top = _best(all_scores, all_ids, k)
                    kept[i] = all_ids[top], all_scores[top]
        if kept:
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i, x in kept.items() for _ in x[0]], arrow), pa.array([y for x in kept.values() for y in x[0]], pa.string()), pa.array(np.concatenate([x[1] for x in kept.values()]))],
                names=["query_id", "id", "score"],
            )

    read = index.rows.where(F.col("cell").isin([int(c) for c in asking]))
    return read.select("id", "embedding", "boundary", "cell").mapInArrow(run, f"query_id {name_type.simpleString()}, id string, score double")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query_id, hits, wanted``: how many of each query's exact results were found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.groupBy("query_id").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("wanted"))


def neighbours(vectors: DataFrame, k: int, floor: float, centres: Centres | None = None, probes: int | None = None) -> DataFrame:
    """``boundary, id, other, score`` as ``knn.neighbours`` gives it, from the cells that a vector probes.

    A row is stored once and sent to ``probes`` cells, so what is shuffled grows with the rows.
    There is about one cell to ``JOIN_BLOCK`` vectors; probing all of them compares all pairs of a
    scope. Equal vectors of a scope look for neighbours once: only the ``k`` + 1 of least id
    can be anyone's neighbours, and each gets the common list without itself, so a vector with
    any number of copies is as much work as with few. A dense region draws more centres.
    """
    base = vectors.where("embedding is not null").select("boundary", "id", "embedding")
    if centres is None:
        centres = fit_centres(vectors, cells=max(1, math.ceil(base.count() / JOIN_BLOCK)))
    probes = centres.probes if probes is None else probes
    same = ["boundary", "embedding"]
    first = Window.partitionBy(*same).orderBy("id")
    targets = base.withColumn("_turn", F.row_number().over(first)).where(F.col("_turn") <= k + 1)
    targets = materialise(placed(targets, centres, probes).withColumn("home", F.col("cells")[0]), "cells-join")
    looking = targets.where("_turn = 1").select(*base.columns, F.explode("cells").alias("cell"))
    stored = targets.select(*[F.col(c).alias(c) for c in base.columns], F.col("home").alias("cell"))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("boundary", "cell").agg(F.ceil(F.count(F.lit(1)) / JOIN_BLOCK).cast("int").alias(name))

    counts = materialise(blocks(looking, "ln").join(blocks(stored, "rn"), ["boundary", "cell"]), "cells-blocks")
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = looking.join(counts, ["boundary", "cell"]).withColumn("lb", dealt("ln")).select(*base.columns, "cell", "lb", F.explode(F.sequence(F.lit(0), F.col("rn") - 1)).alias("rb"))
    right = stored.join(counts, ["boundary", "cell"]).withColumn("rb", dealt("rn")).select(*base.columns, "cell", "rb", F.explode(F.sequence(F.lit(0), F.col("ln") - 1)).alias("lb"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if a.num_rows and b.num_rows:
            x, y = _unit(_matrix(a.column("embedding"))), _unit(_matrix(b.column("embedding")))
            ids, others = a.column("id").to_pylist(), np.array(b.column("id").to_pylist(), dtype=object)
            for lo in range(0, len(x) if x.shape[1] == y.shape[1] else 0, 512):
                scores = x[lo : lo + 512] @ y.T
                for i, me in enumerate(ids[lo : lo + 512]):
                    at = np.flatnonzero(scores[i] >= floor)
                    at = at[_best(scores[i][at], others[at], k + 1)]
                    out[0].extend([me] * len(at))
                    out[1].extend(others[at].tolist())
                    out[2].extend(scores[i][at].tolist())
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.float64()))], names=["first", "other", "score"])

    keys = ["boundary", "cell", "lb", "rb"]
    part = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "first string, other string, score double")
    best = Window.partitionBy("first").orderBy(F.col("score").desc(), "other")
    top = part.withColumn("_turn", F.row_number().over(best)).where(F.col("_turn") <= k + 1)
    lists = top.groupBy("first").agg(F.array_sort(F.collect_list(F.struct(F.col("_turn").alias("turn"), "other", "score"))).alias("found"))  # k + 1 at most
    leader = targets.where("_turn = 1").select(*same, F.col("id").alias("first")).join(lists, "first").select(*same, "found")
    own = base.join(leader, same).withColumn("found", F.slice(F.filter("found", lambda x: x["other"] != F.col("id")), 1, k))
    return own.select("boundary", "id", F.inline("found")).select("boundary", "id", "other", "score")
