"""Keyword index in segments, and BM25 search.

A segment is written once. It holds blocks of up to ``BLOCK_FACTS`` facts; a block has one row
for its facts (ids and lengths) and one row a term: the list of the facts that hold it, as
variable-length bytes, with the largest frequency and the shortest fact of the list. Document
frequencies and length sums are written with the segment and add up over segments. A fact that
is written again or deleted gets a tombstone, and what it added to the frequencies is written as
a negative number, which costs the reading of its block alone. Statistics are those of all scopes.

A search sends the lists of its terms to their blocks' tasks. A task adds up the scores of one
block after the other, skips a block where the largest possible score of a query is below the
last one kept, and hands on its own best ``k`` of each query.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from engram.functions.text import index_terms, without_operators
from engram.functions.varints import from_varints, varints
from engram.operators.knn import _best
from engram.operators.scope import listed
from engram.sources.shared import materialise

K1 = 1.2
B = 0.75
BLOCK_FACTS = 8192
#: Term occurrences of a block, unless one fact has more.
BLOCK_TERMS = 2_000_000
#: Rows of ``query_id, term`` that one pass answers; a term is shorter than ``LONGEST_TOKEN_BYTES``, so 200,000 rows take some 20 MB.
PASS_TERMS = 200_000
#: Hits that a task keeps for the queries of one pass, some 100 MB when they are handed on.
PASS_HITS = 1_000_000
#: Term occurrences that are counted at once, and postings that bytes are made of at once.
SLICE_TERMS = 250_000
SLICE_POSTINGS = 20_000
MOST_TASKS = 20_000
FACTS, GONE, LIST = 0, 1, 2

BLOCK_SCHEMA = T.StructType(
    [
        T.StructField("block", T.StringType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("term", T.StringType()),
        T.StructField("df", T.LongType()),
        T.StructField("most_tf", T.LongType()),
        T.StructField("least_length", T.LongType()),
        T.StructField("ids", T.ArrayType(T.StringType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("postings", T.BinaryType()),
    ]
)


@dataclass(frozen=True)
class KeywordIndex:
    """``blocks`` of all segments with tombstones, ``frequencies`` (term, df; to be added up),
    ``documents`` and the sum of their lengths, the number of segments and of blocks."""

    blocks: DataFrame
    frequencies: DataFrame
    documents: int
    total: int
    segments: int
    n_blocks: int

    @property
    def average(self) -> float:
        return self.total / self.documents if self.documents else 0.0


def _rows(block: str, ids: list[str], lengths: np.ndarray, terms: pa.StringArray | np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, with_facts: bool = True) -> pa.RecordBatch:
    """A block's rows, without that of its facts on demand; postings are in order of term and fact, ``term`` has places in ``terms``."""
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, dtype=np.int64)
    n = len(first)
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]
    flat = np.empty(2 * len(doc), dtype=np.int64)
    flat[0::2], flat[1::2] = gap, tf
    raw, sizes = varints(flat)
    ends = np.r_[0, np.cumsum(sizes)[np.r_[2 * first[1:] - 1, len(flat) - 1]]] if n else np.zeros(1)
    lists = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
    most, least = (np.maximum.reduceat(tf, first), np.minimum.reduceat(lengths[doc], first)) if n else (first, first)
    none = lambda t: pa.nulls(n, t)
    made = pa.RecordBatch.from_arrays(
        [
            pa.array([block] * (n + 1)),
            pa.array(np.r_[FACTS, np.full(n, LIST)], pa.int32()),
            pa.concat_arrays([pa.array([None], pa.string()), pa.array(terms, pa.string()).take(pa.array(term[first]))]),
            pa.array(np.r_[len(ids), np.diff(np.r_[first, len(doc)])].astype(np.int64)),
            pa.array(np.r_[int(lengths.sum()), most].astype(np.int64)),
            pa.array(np.r_[0, least].astype(np.int64)),
            pa.concat_arrays([pa.array([ids], pa.list_(pa.string())), none(pa.list_(pa.string()))]),
            pa.concat_arrays([pa.array([lengths.tolist()], pa.list_(pa.int64())), none(pa.list_(pa.int64()))]),
            pa.concat_arrays([pa.array([None], pa.binary()), lists]),
        ],
        names=BLOCK_SCHEMA.names,
    )
    return made if with_facts else made.slice(1)


def _slices(block: str, ids: list[str], lengths: np.ndarray, terms: pa.StringArray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``_rows`` in parts of about ``SLICE_POSTINGS`` postings; a term stays whole."""
    lo, n = 0, len(term)
    while True:
        hi = int(np.searchsorted(term, term[min(lo + SLICE_POSTINGS, n) - 1], side="right")) if n else 0
        yield _rows(block, [] if lo else ids, lengths, terms, term[lo:hi], doc[lo:hi], tf[lo:hi], lo == 0)
        lo = hi
        if lo == n:
            return


class _Counted:
    """Postings of a block's facts as numbers; of the texts a slice's distinct terms are held on to."""

    def __init__(self):
        self.ids: list[str] = []
        self.lengths: list[np.ndarray] = []
        self.words: list[pa.StringArray] = []
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.terms = 0

    def add(self, ids: list[str], lists: pa.ListArray) -> None:
        lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        doc = np.repeat(np.arange(len(ids)), lengths)
        posting, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(ids) + doc, return_counts=True)
        term, doc = np.divmod(posting, len(ids))
        self.words.append(words.dictionary)
        self.postings.append((term.astype(np.int32), (doc + len(self.ids)).astype(np.int32), tf.astype(np.int32)))
        self.ids += ids
        self.lengths.append(lengths)
        self.terms += int(lengths.sum())

    def rows(self, block: str) -> Iterator[pa.RecordBatch]:
        words = pa.concat_arrays(self.words).dictionary_encode()
        places = np.split(words.indices.to_numpy(), np.cumsum([len(w) for w in self.words])[:-1])
        term = np.concatenate([at[p[0]] for at, p in zip(places, self.postings)])
        doc, tf = (np.concatenate([p[i] for p in self.postings]) for i in (1, 2))
        self.words.clear()
        self.postings.clear()
        # Facts were added in order, so a stable sort leaves a term's facts in order.
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        del order, places
        # Words stay in Arrow, as a block may have as many different ones as it has terms.
        yield from _slices(block, self.ids, np.concatenate(self.lengths), words.dictionary, term, doc, tf)


def _indexer(name: str, most_facts: int, most_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of at most so many facts and term occurrences from rows of ``id, terms``; a single fact may have more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, turn = TaskContext.get().partitionId(), 0
        held = _Counted()
        for batch in batches:
            ids, lists = batch.column("id"), batch.column("terms")
            sizes, lo = np.diff(lists.offsets.to_numpy()), 0
            while lo < len(sizes):
                ends = np.cumsum(sizes[lo : lo + most_facts - len(held.ids)])
                fit = int(np.searchsorted(ends, most_terms - held.terms, side="right"))
                if not fit and held.ids:
                    yield from held.rows(f"{name}-{part}-{turn}")
                    held, turn = _Counted(), turn + 1
                    continue
                n = max(1, min(fit, int(np.searchsorted(ends, SLICE_TERMS, side="right"))))
                held.add(ids.slice(lo, n).to_pylist(), lists.slice(lo, n))
                lo += n
        if held.ids:
            yield from held.rows(f"{name}-{part}-{turn}")

    return run


def _segment(facts: DataFrame) -> DataFrame:
    """Blocks of facts, written; each text is split once and nothing is shuffled."""
    split = facts.select("id", F.coalesce(index_terms(F.col("content")), F.array().cast("array<string>")).alias("terms"))
    return materialise(split.mapInArrow(_indexer(uuid.uuid4().hex[:12], BLOCK_FACTS, BLOCK_TERMS), BLOCK_SCHEMA), "keyword-segment")


def _frequencies(blocks: DataFrame) -> DataFrame:
    return materialise(blocks.where(F.col("kind") == LIST).groupBy("term").agg(F.sum("df").alias("df")), "keyword-frequencies")


def _sizes(blocks: DataFrame) -> tuple[int, int, int]:
    """Facts, their lengths and blocks of written blocks."""
    r = blocks.where(F.col("kind") == FACTS).agg(F.sum("df"), F.sum("most_tf"), F.count(F.lit(1))).first()
    return r[0] or 0, r[1] or 0, r[2]


def build_index(memories: DataFrame) -> KeywordIndex:
    """Index of the facts that are neither superseded nor archived; a fact without text counts with length 0."""
    blocks = _segment(memories.where(listed()))
    documents, total, n = _sizes(blocks)
    return KeywordIndex(blocks, _frequencies(blocks), documents, total, 1, n)


def _by_block(rows: DataFrame, n_blocks: int) -> DataFrame:
    """Rows dealt to tasks by block, a block's facts first, then its tombstones, then its lists.

    Lists have empty arrays of facts in place of null ones: with every row that goes to Python,
    Spark 4.1 fills an Arrow list column anew from its last array on, for the size of the batch,
    so that rows of null arrays take a time that grows with their square.
    """
    dealt = rows.repartition(min(max(n_blocks, 1), MOST_TASKS), "block").sortWithinPartitions("block", "kind", "term")
    return dealt.withColumns({c: F.coalesce(c, F.array().cast(BLOCK_SCHEMA[c].dataType)) for c in ("ids", "lengths")})


class _Block:
    """Facts, tombstones and lists of one block."""

    def __init__(self, name: str):
        self.name, self.ids, self.lengths, self.gone = name, [], np.zeros(0, dtype=np.int64), set()
        self.lists: dict[str, tuple[int, int, bytes]] = {}

    def live(self) -> np.ndarray:
        return np.array([i not in self.gone for i in self.ids], dtype=bool) if self.gone else np.ones(len(self.ids), dtype=bool)


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """The blocks of a task's rows one after the other."""
    block = None
    for batch in batches:
        for name, kind, term, most, least, ids, lengths, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "term", "most_tf", "least_length", "ids", "lengths", "postings"))):
            if block is None or block.name != name:
                if block is not None:
                    yield block
                block = _Block(name)
            if kind == FACTS:
                block.ids, block.lengths = ids, np.array(lengths, dtype=np.int64)
            elif kind == GONE:
                block.gone.update(ids)
            else:
                block.lists[term] = (most, least, raw)
    if block is not None:
        yield block


def _decoded(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the facts of a list and the term's frequency in each."""
    numbers = from_varints(raw)
    return np.cumsum(numbers[0::2]), numbers[1::2]


def _all_decoded(block: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lists of a block in one: how many facts each has, their places, the frequencies."""
    raws = [raw for _, _, raw in block.lists.values()]
    joined = b"".join(raws)
    numbers = from_varints(joined)
    last = np.cumsum([len(raw) for raw in raws]) - 1
    # A number ends where the top bit is not set; a fact is two numbers.
    sizes = np.diff(np.cumsum(np.frombuffer(joined, dtype=np.uint8) < 128)[last], prepend=0) // 2 if raws else np.zeros(0, dtype=np.int64)
    gaps = numbers[0::2]
    ends, starts = np.cumsum(gaps), np.cumsum(sizes) - sizes
    return sizes, ends - np.repeat(ends[starts] - gaps[starts], sizes), numbers[1::2]


def upsert_index(old: KeywordIndex, changed: DataFrame, deleted: DataFrame) -> KeywordIndex:
    """The index after ``changed`` facts were written again and ``deleted`` ids removed.

    ``changed`` goes to a segment of its own. Blocks that hold an id that is written again or
    removed are read once, for the frequencies that go with it; nothing else is counted again.
    """
    ids = changed.select("id").unionByName(deleted.select("id")).distinct()
    have = old.blocks.where(F.col("kind") == FACTS).select("block", F.explode(F.arrays_zip("ids", "lengths")).alias("f")).select("block", F.col("f.ids").alias("id"), F.col("f.lengths").alias("length"))
    past = old.blocks.where(F.col("kind") == GONE).select("block", F.explode("ids").alias("id"))
    gone = materialise(have.join(ids, "id", "left_semi").join(past, ["block", "id"], "left_anti"), "keyword-gone")
    stones = gone.groupBy("block").agg(F.collect_list("id").alias("ids"))  # a block's at most
    stones = materialise(stones.select(*[{"block": F.col("block"), "kind": F.lit(GONE), "ids": F.col("ids")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in BLOCK_SCHEMA.fields]), "keyword-tombstones")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _each_block(batches):
            if block.lists:
                sizes, doc, _ = _all_decoded(block)
                less = np.add.reduceat((~block.live())[doc].astype(np.int64), np.cumsum(sizes) - sizes)
                some = np.flatnonzero(less)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(list(block.lists), dtype=object)[some].tolist(), pa.string()), pa.array(-less[some])], names=["term", "df"])

    touched = old.blocks.where(F.col("kind") != GONE).join(stones.select("block"), "block", "left_semi").select(*BLOCK_SCHEMA.names)
    fewer = materialise(_by_block(touched.unionByName(stones), old.n_blocks).mapInArrow(taken, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df")), "keyword-frequencies")
    n_gone, length_gone = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    new = build_index(changed)
    return KeywordIndex(
        old.blocks.unionByName(stones).unionByName(new.blocks),
        old.frequencies.unionByName(fewer).unionByName(new.frequencies),
        old.documents - n_gone + new.documents,
        old.total - length_gone + new.total,
        old.segments + 1,
        old.n_blocks + new.n_blocks,
    )


def compacted(index: KeywordIndex) -> KeywordIndex:
    """One segment without tombstones; blocks keep their facts, so lists are read and written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _each_block(batches):
            live = block.live()
            if not live.any():
                continue
            places, terms = np.cumsum(live) - 1, pa.array(list(block.lists), pa.string())
            sizes, doc, tf = _all_decoded(block)
            term, some = np.repeat(np.arange(len(terms)), sizes), live[doc]
            yield from _slices(block.name, [i for i, x in zip(block.ids, live) if x], block.lengths[live], terms, term[some], places[doc[some]], tf[some])

    blocks = materialise(_by_block(index.blocks, index.n_blocks).mapInArrow(run, BLOCK_SCHEMA), "keyword-segment")
    documents, total, n = _sizes(blocks)
    return KeywordIndex(blocks, _frequencies(blocks), documents, total, 1, n)


def postings(index: KeywordIndex) -> DataFrame:
    """``term, id, tf, length``: what the index holds, a row a fact and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _each_block(batches):
            # Terms and ids are taken in Arrow: a row a posting makes no Python object.
            live, ids, terms = block.live(), pa.array(block.ids, pa.string()), pa.array(list(block.lists), pa.string())
            sizes, doc, tf = _all_decoded(block)
            term = np.repeat(np.arange(len(terms)), sizes)
            some = np.flatnonzero(live[doc])
            for lo in range(0, len(some), 100_000):
                at = some[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(term[at])), ids.take(pa.array(doc[at])), pa.array(tf[at]), pa.array(block.lengths[doc[at]])], names=["term", "id", "tf", "length"])

    return _by_block(index.blocks, index.n_blocks).mapInArrow(run, "term string, id string, tf bigint, length bigint")


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term``: distinct terms of each query text without operators."""
    return queries.select("query_id", F.explode(F.array_distinct(index_terms(without_operators(F.col("text"))))).alias("term"))


def search(queries: DataFrame, index: KeywordIndex, k: int) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` best facts of each query; ties by id.

    A query without terms finds nothing. Scores are rounded to nine places, so that the order in
    which a sum was added up cannot change a rank. One pass over the lists answers queries of
    about ``PASS_TERMS`` terms together, which go to every executor, and of at most about
    ``PASS_HITS`` hits; a query stays whole.
    """
    spark = index.blocks.sparkSession
    wanted = materialise(query_terms(queries), "keyword-terms")
    kind = queries.schema["query_id"].dataType
    terms, asking = wanted.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    passes = max(1, math.ceil(terms / PASS_TERMS), math.ceil(asking * k / PASS_HITS))
    found = None
    for turn in range(passes):
        part = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == turn)
        df = index.frequencies.join(F.broadcast(part.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        idf = {r.term: math.log(1 + (index.documents - r.df + 0.5) / (r.df + 0.5)) for r in df.toLocalIterator()}
        asked: dict = defaultdict(list)
        for r in part.toLocalIterator():
            if r.term in idf:
                asked[r.query_id].append(r.term)
        # From Arrow, as rows from Python objects would start Python workers of another kind beside those that score.
        known = spark.createDataFrame(pa.table({"term": pa.array(list(idf), pa.string())}))
        lists = index.blocks.where(F.col("kind") == LIST).join(F.broadcast(known), "term", "left_semi").select(*BLOCK_SCHEMA.names)
        rows = index.blocks.where(F.col("kind") != LIST).unionByName(lists)
        shared = spark.sparkContext.broadcast((idf, dict(asked)))
        best = _by_block(rows, index.n_blocks).mapInArrow(_scorer(shared, index.average or 1.0, k, to_arrow_type(kind)), f"query_id {kind.simpleString()}, id string, score double")
        found = best if found is None else found.unionByName(best)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _scorer(shared, average: float, k: int, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, asked = shared.value
        kept: dict = {}
        for block in _each_block(batches):
            if not block.lists:
                continue
            live, ids = block.live(), np.array(block.ids, dtype=object)
            norm = K1 * (1 - B + B * block.lengths / average)
            bound = {t: idf[t] * most * (K1 + 1) / (most + K1 * (1 - B + B * least / average)) for t, (most, least, _) in block.lists.items()}
            ready: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for query, terms in asked.items():
                here = [t for t in terms if t in bound]
                old = kept.get(query)
                full = old is not None and len(old[0]) == k
                # Slack for the rounding of scores.
                if not here or (full and sum(bound[t] for t in here) + 1e-8 < old[1].min()):
                    continue
                scores = np.zeros(len(ids))
                for t in here:
                    if t not in ready:
                        doc, tf = _decoded(block.lists[t][2])
                        ready[t] = doc, idf[t] * tf * (K1 + 1) / (tf + norm[doc])
                    scores[ready[t][0]] += ready[t][1]
                at = np.flatnonzero((scores > 0) & live)
                if full:
                    at = at[scores[at] + 1e-8 >= old[1].min()]
                all_ids, all_scores = ids[at], np.round(scores[at], 9)
                if old is not None:
                    all_ids, all_scores = np.concatenate((old[0], all_ids)), np.concatenate((old[1], all_scores))
                top = _best(all_scores, all_ids, k)
                kept[query] = all_ids[top], all_scores[top]
        if kept:
            yield pa.RecordBatch.from_arrays(
                [pa.array([q for q, x in kept.items() for _ in x[0]], kind), pa.array([i for x in kept.values() for i in x[0]], pa.string()), pa.array(np.concatenate([x[1] for x in kept.values()]))],
                names=["query_id", "id", "score"],
            )

    return run
