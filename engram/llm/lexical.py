"""Ranked lexical search over an index of shards.

A shard holds up to about ``SHARD_BYTES`` of neighbouring texts. Its documents are put in order
of doc_id; every term has one list of postings in that order, as variable-length bytes: the
distance to the document before and the occurrences. Building needs no shuffle, and an index is
a written table, so a lost executor costs the reading of one shard again.

A search takes the statistics of all shards, then reads the lists of the queries' terms. In a
shard each query is answered document at a time: a heap merges the cursors of its lists, the
least document comes out with all lists that stand at it, and a heap of bounded size, keyed by
score and then doc_id, keeps the best. Lists whose largest shares together cannot lift a
document over the last one kept leave the merge and are only looked up. The shards' best lists
meet in one ranking.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from engram.functions.varints import from_varints, varints
from engram.llm.memory import tidied
from engram.sources.shared import materialise

#: Text of one shard; its terms are held as 8 bytes an occurrence while it is built.
SHARD_BYTES = 12 << 20
#: Terms of queries (each query's distinct ones) that one pass over the index answers; a query stays whole.
BLOCK_TERMS = 100_000
#: Most tasks that shards are dealt to in a search.
MOST_TASKS = 20_000
BEST = 20
#: Fixed values of the score: 100 - 25 and 25 of the length share, 12 tenths, and the two scales.
LENGTH_BASE, LENGTH_SHARE, K, TF_SCALE, WEIGHT_SCALE = 75, 25, 12, 1_000_000_000, 1000
#: Every separator becomes a space, A-Z become a-z; all bytes of other characters are kept.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SHARD_SCHEMA = T.StructType(
    [
        T.StructField("shard", T.StringType()),
        T.StructField("term", T.BinaryType()),
        T.StructField("df", T.LongType()),
        T.StructField("occurrences", T.LongType()),
        T.StructField("postings", T.BinaryType()),
    ]
)


@dataclass(frozen=True)
class LexicalIndex:
    """``shards``: a row a shard and term with its list, and a row a shard without a term that has
    its documents' ids and lengths (``df`` documents with a term, ``occurrences`` of all terms)."""

    shards: DataFrame
    count: int
    documents: int
    occurrences: int
    id_type: T.DataType


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters and digits and of all other characters beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


class _Terms(dict):
    """Numbers of terms in order of their first coming."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def shard_of(name: str, ids: list[int | None], texts: list[bytes | None]) -> pa.RecordBatch | None:
    """One shard's rows. Rows without an id come last; a text without terms is no document."""
    terms, numbers, counts = _Terms(), [], []
    for text in texts:
        found = terms_of(text)
        counts.append(len(found))
        numbers.append(np.fromiter(map(terms.__getitem__, found), dtype=np.int32, count=len(found)))
    lengths = np.array(counts, dtype=np.int64)
    kept = np.flatnonzero(lengths > 0)
    if not len(kept):
        return None
    key = np.array([(1 << 63) - 1 if i is None else i for i in ids], dtype=np.int64)
    order = kept[np.lexsort((np.array([i is None for i in ids])[kept], key[kept]))]
    place = np.repeat(np.arange(len(order)), lengths[order])
    posting, tf = np.unique(np.concatenate([numbers[i] for i in order]).astype(np.int64) * len(order) + place, return_counts=True)
    term, doc = np.divmod(posting, len(order))
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]
    flat = np.empty(2 * len(doc), dtype=np.int64)
    flat[0::2], flat[1::2] = gap, tf
    raw, sizes = varints(flat)
    ends = np.cumsum(sizes)[np.r_[2 * first[1:] - 1, len(flat) - 1]]
    lists = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
    # The documents' row: how many, how many of them (the last) without an id, all ids, all lengths.
    missing = sum(ids[d] is None for d in order.tolist())
    about = np.concatenate(([len(order), missing], key[order], lengths[order])).astype("<i8").tobytes()
    by_number = list(terms)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name] * (len(first) + 1)),
            pa.array([None, *(by_number[i] for i in term[first].tolist())], pa.binary()),
            pa.array(np.r_[len(order), np.diff(np.r_[first, len(doc)])]),
            pa.array(np.r_[lengths[order].sum(), np.add.reduceat(tf, first)]),
            pa.concat_arrays([pa.array([about], pa.binary()), lists]),
        ],
        names=SHARD_SCHEMA.names,
    )


def build_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LexicalIndex:
    """The index of all ``documents``, written to shared storage.

    Null texts and texts without terms are no documents. Repeated rows are documents of their
    own. Whole texts of any length are read; one longer than ``SHARD_BYTES`` is a shard by
    itself. Other columns are not read. An empty table gives an index without shards.
    """
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[bytes | None] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n, held
            made = shard_of(f"{part}-{n}", ids, texts)
            n, held = n + 1, 0
            ids.clear()
            texts.clear()
            if made is not None:
                for lo in range(0, made.num_rows, 20_000):
                    yield made.slice(lo, 20_000)

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                size = len(t or b"")
                if ids and held + size > SHARD_BYTES:
                    yield from flush()
                ids.append(i)
                texts.append(t)
                held += size
        if ids:
            yield from flush()

    shards = materialise(rows.mapInArrow(tidied(run), SHARD_SCHEMA), "lexical-index")
    total = shards.where("term is null").agg(F.count(F.lit(1)), F.sum("df"), F.sum("occurrences")).first()
    return LexicalIndex(shards, total[0], total[1] or 0, total[2] or 0, documents.schema[doc_id].dataType)


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """``query_id, term, repeats``; rows that share an id are one query, equal rows count once."""
    folded = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(folded, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    rows = queries.select(F.col(query_id).alias("query_id"), F.col(text)).distinct()
    return rows.select("query_id", F.explode(found).alias("term")).select("query_id", F.col("term").cast("binary")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("repeats"))


def weight(documents: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * df + 1)))


class _List:
    """One term's postings in a shard: documents by place, each one's share of a score, the largest share."""

    __slots__ = ("docs", "shares", "most")

    def __init__(self, raw: bytes, w: int, norms: np.ndarray):
        numbers = from_varints(raw)
        docs, tf = np.cumsum(numbers[0::2]), numbers[1::2]
        shares = w * ((TF_SCALE * tf) // (WEIGHT_SCALE * tf + K * norms[docs]))
        self.docs, self.shares, self.most = docs.tolist(), shares.tolist(), int(shares.max())


def best_documents(lists: list[tuple[_List, int]], k: int) -> list[tuple[int, int]]:
    """``(score, place)`` of the ``k`` best documents, best first; ``lists`` with the term's repeats in the query.

    Lists are in order of their largest share. The first ``spare`` of them cannot together lift
    a document over the last one kept, so only the others are merged.
    """
    lists = sorted(lists, key=lambda x: x[0].most * x[1])
    most = [x.most * q for x, q in lists]
    within = [0]
    for m in most:
        within.append(within[-1] + m)
    cursors = [0] * len(lists)
    kept: list[tuple[int, int]] = []  # (score, -place), least first
    floor, spare = 0, 0
    heap = [(x.docs[0], i) for i, (x, _) in enumerate(lists)]
    heapq.heapify(heap)
    while heap:
        doc, score = heap[0][0], 0
        while heap and heap[0][0] == doc:
            i = heap[0][1]
            if i < spare:
                heapq.heappop(heap)
                continue
            x, q = lists[i]
            at = cursors[i]
            score += q * x.shares[at]
            cursors[i] = at = at + 1
            if at < len(x.docs):
                heapq.heapreplace(heap, (x.docs[at], i))
            else:
                heapq.heappop(heap)
        if not score:
            continue
        for i in range(spare - 1, -1, -1):
            if score + within[i + 1] <= floor:
                break
            x, q = lists[i]
            at = cursors[i] = bisect_left(x.docs, doc, cursors[i])
            if at < len(x.docs) and x.docs[at] == doc:
                score += q * x.shares[at]
        if score > floor:
            if len(kept) < k:
                heapq.heappush(kept, (score, -doc))
            else:
                heapq.heapreplace(kept, (score, -doc))
            if len(kept) == k:
                floor = kept[0][0]
                while spare < len(lists) and within[spare + 1] <= floor:
                    spare += 1
    return [(s, -d) for s, d in sorted(kept, key=lambda x: (-x[0], -x[1]))]


def search(queries: DataFrame, index: LexicalIndex, k: int = BEST, query_id: str = "item_id", text: str = "text") -> DataFrame:
    """``<query_id>, rank, doc_id, score``: each query's ``k`` best documents with a score above 0.

    Ranks are unique from 1; equal scores by ascending doc_id, documents without an id after
    them. A query without a term that the index knows has no rows; rows with a null id are one
    query. Queries go through in blocks of ``BLOCK_TERMS`` terms, each block one pass over the
    lists of its terms.
    """
    spark = index.shards.sparkSession
    asked = materialise(query_terms(queries, query_id, text), "lexical-queries")
    kind = queries.schema[query_id].dataType
    arrow, out_schema = to_arrow_type(kind), f"query_id {kind.simpleString()}, doc_id bigint, score bigint"
    blocks = max(1, math.ceil(asked.count() / BLOCK_TERMS))
    tasks = min(max(index.count, 1), MOST_TASKS)
    rows = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        df = index.shards.join(part.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        weighted: dict[bytes, int] = {bytes(r.term): weight(index.documents, r.df) for r in df.toLocalIterator()}
        wanted: dict = defaultdict(Counter)
        for r in part.toLocalIterator():
            if weighted.get(bytes(r.term)):
                wanted[r.query_id][bytes(r.term)] += r.repeats
        shared = spark.sparkContext.broadcast((weighted, dict(wanted)))
        known = spark.createDataFrame([(t,) for t, w in weighted.items() if w], "term binary")
        lists = index.shards.where("term is not null").join(F.broadcast(known), "term", "left_semi")
        found = index.shards.where("term is null").unionByName(lists).repartition(tasks, "shard").groupBy("shard").applyInArrow(_searcher(shared, k, index.documents, index.occurrences, arrow), out_schema)
        rows = found if rows is None else rows.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id), "rank", F.col("doc_id").cast(index.id_type), "score")


def _searcher(shared, k: int, documents: int, occurrences: int, kind: pa.DataType):
    def run(shard: pa.Table) -> pa.Table:
        weighted, wanted = shared.value
        rows = dict(zip(shard.column("term").to_pylist(), shard.column("postings").to_pylist()))
        about = np.frombuffer(rows.pop(None), dtype="<i8")
        n, missing = int(about[0]), int(about[1])
        ids, lengths = about[2 : n + 2], about[n + 2 :]
        norms = LENGTH_BASE + (LENGTH_SHARE * lengths * documents) // occurrences
        lists = {t: _List(raw, weighted[t], norms) for t, raw in rows.items()}
        out: tuple[list, list, list] = ([], [], [])
        for query, terms in wanted.items():
            for score, place in best_documents([(lists[t], q) for t, q in terms.items() if t in lists], k):
                out[0].append(query)
                out[1].append(None if place >= n - missing else int(ids[place]))
                out[2].append(score)
        types = (kind, pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=["query_id", "doc_id", "score"])

    return run


#: DuckDB. The letters of the class are those of ``terms_of``.
ORACLE = r"""
WITH doc AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
item AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT item_id, term, count(*) AS q FROM item GROUP BY item_id, term),
stat AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS total FROM doc WHERE len(ts) > 0),
posting AS (SELECT row, doc_id, len(ts) AS n, unnest(ts) AS term FROM doc WHERE len(ts) > 0),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM posting WHERE term IN (SELECT term FROM asked) GROUP BY row, doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, stat GROUP BY term, docs),
scored AS (SELECT item_id, row, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term), stat GROUP BY item_id, row, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""
