"""Near-duplicate documents by BagMinHash: weighted Jaccard over five-word shingles.

Signatures. Every distinct shingle of a document, with its count as weight, owns marked
Poisson processes on the intervals [0,1), [1,2), [2,4), [4,8), ... of the weight axis up to
its weight. Points arrive in order of time at a rate in proportion to the interval's length;
each has a position in the interval, discretised to whole counts, and a component of the
signature. Points at or above the weight do not count (this is how an interval that the
weight covers in part is split). A component keeps its earliest time, and a process stops
once its time exceeds every component's. Two documents agree in a component with
probability sum(min) / sum(max) over their shingle counts.

Bands of ``ROWS`` components put documents into buckets. Inside a bucket no list of all
pairs is made. Every member is held against the bucket's centre, the member that shares
most buckets with others, and what is similar to it becomes one class. A pair of two other
members can still join two classes only if it is similar itself, and the comparison with
the centre bounds that: with ``m`` shingles in common with the centre each, the two have at
most ``min(m, m') + a`` in common, where ``a`` counts shingles that both have beyond the
centre's. Bitmaps of those shingles that at least two members have bound ``a`` from above.
Pairs across classes that these bounds leave possible are checked, so none that shares a
bucket is missed. Every check compares the whole shingle counts.

Equal texts (up to white space) are one node throughout: copies cost a row in the final
join and nothing before. All tables between the steps are written to shared storage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.operators.components import connected_components
from engram.llm.memory import tidied
from engram.sources.shared import drop, materialise
from engram.llm.substring_dedup import _A, _B, _C, _WordHashes, mix, window_hashes, words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 28
ROWS = 4
CHUNK_WORDS = 250_000
BITMAP_WORDS = 8


def shingle_counts(names: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts; fewer than ``k`` words make one shingle."""
    if not len(names):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if len(names) < k:
        whole = np.uint64(len(names))
        for x in names:
            whole = mix(whole * _A + x)
        return np.array([whole], dtype=np.uint64), np.ones(1, dtype=np.int64)
    return np.unique(window_hashes(names, k), return_counts=True)


def bag_minhash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (``n_docs`` by ``m`` arrival times; infinite for a document without shingles)."""
    sig = np.full(n_docs * m, np.inf)
    parts, lo, k = [], 0, 0
    while True:
        length = 1 if lo == 0 else lo
        at = np.flatnonzero(weight > lo)
        if not len(at):
            break
        parts.append((doc[at], mix(shingle[at] + _C * np.uint64(k)), np.full(len(at), lo), np.full(len(at), length), weight[at]))
        lo, k = lo + length, k + 1
    if not parts:
        return sig.reshape(n_docs, m)
    doc, seed, lo, length, weight = (np.concatenate(x) for x in zip(*parts))
    rate = length.astype(np.float64) * m
    t = np.zeros(len(doc))
    worst = np.full(n_docs, np.inf)
    j = 0
    while len(doc):
        j += 1
        r = mix(seed + _A * np.uint64(j))
        t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        r = mix(r + _B)
        component = ((r >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        mark = lo + (((r & np.uint64(0xFFFFFFFF)) * length.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        ok = mark < weight
        np.minimum.at(sig, doc[ok] * m + component[ok].astype(np.int64), t[ok])
        some = np.unique(doc)
        worst[some] = sig.reshape(n_docs, m)[some].max(axis=1)
        on = t <= worst[doc]
        doc, seed, lo, length, weight, rate, t = (x[on] for x in (doc, seed, lo, length, weight, rate, t))
    return sig.reshape(n_docs, m)


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    out = np.zeros((len(sig), bands), dtype=np.uint64)
    for r in range(rows):
        out = mix(out * _A + bits[:, :, r] + np.uint64(r + 1))
    return out


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two shingle count lists (sorted hashes and counts)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least / (int(a[1].sum()) + int(b[1].sum()) - least)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, squeeze = _WordHashes(), zstandard.ZstdCompressor(level=1)
    m = BANDS * ROWS
    ids: list = []
    raws: list = []
    lists: list[list[bytes]] = []
    gathered = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal gathered
        joined = [b" ".join(w) for w in lists]
        tids = np.array([xxhash.xxh3_64_intdigest(x) for x in joined], dtype=np.uint64)
        _, first = np.unique(tids, return_index=True)
        first.sort()
        counts = [shingle_counts(np.fromiter(map(table.__getitem__, lists[i]), dtype=np.uint64, count=len(lists[i]))) for i in first]
        doc = np.repeat(np.arange(len(first)), [len(c[0]) for c in counts])
        sig = bag_minhash(doc, np.concatenate([c[0] for c in counts]), np.concatenate([c[1] for c in counts]), len(first), m)
        bands = band_hashes(sig).view(np.int64)
        described = np.zeros(len(lists), dtype=bool)
        described[first] = True
        some = np.array([len(c[0]) > 0 for c in counts], dtype=bool)
        described[first[~some]] = False
        sizes = np.where(described, BANDS, 0)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays(ids),
                pa.concat_arrays(raws),
                pa.array(tids.view(np.int64)),
                pa.array([max(1, len(w) - SHINGLE + 1) if w else 0 for w in lists], pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[some].reshape(-1))),
                pa.array([squeeze.compress(x) if d else None for x, d in zip(joined, described)], pa.binary()),
            ],
            names=["doc_id", "raw", "tid", "n", "bands", "content"],
        )
        ids.clear(), raws.clear(), lists.clear()
        gathered = 0

    with np.errstate(over="ignore"):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                ids.append(part.column("doc_id"))
                raws.append(part.column("raw"))
                for text in part.column("text"):
                    words = words_of(text.as_py())
                    lists.append(words)
                    gathered += len(words) + 20
                if gathered >= CHUNK_WORDS:
                    yield from flush()
        if lists:
            yield from flush()


def _beyond(x: tuple[np.ndarray, np.ndarray], centre: tuple[np.ndarray, np.ndarray]) -> tuple[int, np.ndarray]:
    """Common shingles of two count lists, and a hash for each shingle that ``x`` has in excess."""
    _, i, j = np.intersect1d(x[0], centre[0], assume_unique=True, return_indices=True)
    least = np.minimum(x[1][i], centre[1][j])
    excess = x[1].copy()
    excess[i] -= least
    shingle = np.repeat(x[0], excess)
    copy = np.arange(len(shingle)) - np.repeat(np.cumsum(excess) - excess, excess) + np.repeat(x[1] - excess, excess)
    return int(least.sum()), mix(shingle + _C * copy.astype(np.uint64))


def _checked(similarity: float, excess: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, widen = _WordHashes(), zstandard.ZstdDecompressor()

        def counts(packed: bytes):
            words = widen.decompress(packed).split()
            return shingle_counts(np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=len(words)))

        last, held = None, None
        with np.errstate(over="ignore"):
            for whole in batches:
                for lo in range(0, whole.num_rows, 2000):
                    batch = whole.slice(lo, 2000)
                    n, m, similar, more = [], [], [], []
                    for a, packed_a, packed_b in zip(batch.column("a").to_pylist(), batch.column("content_a"), batch.column("content_b")):
                        if a != last:
                            last, held = a, counts(packed_a.as_py())
                        other = counts(packed_b.as_py())
                        common, beyond = _beyond(other, held)
                        n.append(int(other[1].sum()))
                        m.append(common)
                        similar.append(common >= similarity * (n[-1] + int(held[1].sum()) - common) - 1e-9)
                        more.append(beyond.view(np.int64) if excess else ())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("a"), batch.column("b"), pa.array(n, pa.int32()), pa.array(m, pa.int32()), pa.array(similar, pa.bool_()), pa.array(more, pa.list_(pa.int64()))],
                        names=["a", "b", "n", "m", "similar", "beyond"],
                    )

    return run


def _check_pairs(pairs: DataFrame, content: DataFrame, similarity: float, excess: bool) -> DataFrame:
    """``a, b, n, m, similar, beyond``: size of ``b``, what it shares with ``a``, the verdict, and its excess."""
    a = content.select(F.col("tid").alias("a"), F.col("content").alias("content_a"))
    b = content.select(F.col("tid").alias("b"), F.col("content").alias("content_b"))
    joined = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "content_a", "content_b")
    kind = "a bigint, b bigint, n int, m int, similar boolean, beyond array<bigint>"
    return materialise(joined.mapInArrow(tidied(_checked(similarity, excess)), kind), "near-checked")


def _stars(members: DataFrame) -> DataFrame:
    """Distinct pairs of a bucket's centre ``a`` and another member ``b``."""
    mass = members.groupBy("tid").agg(F.sum("c").alias("mass"))
    centre = members.select("key", "tid").join(mass, "tid").groupBy("key").agg(F.min(F.struct((-F.col("mass")).alias("mass"), "tid")).alias("l")).select("key", F.col("l.tid").alias("a"))
    return members.select("key", F.col("tid").alias("b")).join(centre, "key").where("a <> b").select("a", "b").distinct()


def _possible(stars: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Pairs of members around one centre, in different classes, that the bounds leave possible."""
    around = stars.join(labels, stars["b"] == labels["node"], "left").select("a", "b", "n", "m", "beyond", F.coalesce("label", "b").alias("label"))
    sizes = around.groupBy("a", "label").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"))
    groups = sizes.groupBy("a").agg(F.max(F.struct("c", "label")).alias("most"), F.min("n").alias("least_n"), F.count(F.lit(1)).alias("classes"))
    groups = groups.where("classes > 1").select("a", F.col("most.label").alias("most"), "least_n")
    around = around.join(groups, "a")
    half = similarity / (1 + similarity)
    smallest = F.greatest(F.ceil(F.col("n") * similarity - 1e-9), F.col("least_n"))
    # Members that could not reach a partner even if all their excess were shared go first.
    around = around.where(F.col("m") + F.size("beyond") >= half * (F.col("n") + smallest) - 1e-6)
    each = around.select("a", "b", F.explode("beyond").alias("s"))
    twice = each.groupBy("a", "s").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a", "s")
    bit = F.expr("shiftleft(1L, cast(pmod(s, 64) as int))")
    word = F.expr(f"pmod(shiftright(s, 6), {BITMAP_WORDS})")
    maps = each.join(twice, ["a", "s"]).groupBy("a", "b").agg(
        F.count(F.lit(1)).cast("int").alias("k"), *[F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"w{i}") for i in range(BITMAP_WORDS)]
    )
    words = [F.coalesce(f"w{i}", F.lit(0).cast("bigint")).alias(f"w{i}") for i in range(BITMAP_WORDS)]
    told = around.drop("beyond").join(maps, ["a", "b"], "left").select("a", "b", "n", "m", "label", "most", "least_n", F.coalesce("k", F.lit(0)).alias("k"), *words)
    told = told.where(F.col("m") + F.col("k") >= half * (F.col("n") + smallest) - 1e-6)
    filled = sum((F.bit_count(f"w{i}") for i in range(1, BITMAP_WORDS)), F.bit_count("w0"))
    told = materialise(told.withColumn("over", F.col("k") - filled), "near-around")
    x, y = told.where("label <> most").alias("x"), told.alias("y")
    both = sum((F.bit_count(F.col(f"x.w{i}").bitwiseAND(F.col(f"y.w{i}"))) for i in range(1, BITMAP_WORDS)), F.bit_count(F.col("x.w0").bitwiseAND(F.col("y.w0"))))
    fits = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(similarity) - 1e-9
    reach = F.least("x.m", "y.m") + both + F.least("x.over", "y.over") >= half * (F.col("x.n") + F.col("y.n")) - 1e-6
    once = (F.col("x.b") < F.col("y.b")) | (F.col("y.label") == F.col("y.most"))
    pairs = x.join(y, F.col("x.a") == F.col("y.a")).where((F.col("x.label") != F.col("y.label")) & fits & reach & once)
    return pairs.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()


def _placed(documents: DataFrame, doc_id: str, text: str, similarity: float) -> DataFrame:
    """One row a document: ``doc_id, raw, label``. The label names the class, also one without any doc_id."""
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("raw"), F.col(text).alias("text"))
    told = materialise(rows.mapInArrow(tidied(_describe), "doc_id bigint, raw bigint, tid bigint, n int, bands array<bigint>, content binary"), "near-described")
    nodes = told.where(F.size("bands") > 0).groupBy("tid").agg(F.first("bands").alias("bands"))
    every = nodes.select("tid", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("key"), "tid")
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = materialise(every.join(shared, "key"), "near-members")
    content = materialise(
        told.where(F.col("content").isNotNull()).select("tid", "content").join(members.select("tid").distinct(), "tid", "left_semi").dropDuplicates(["tid"]),
        "near-content",
    )
    stars = _check_pairs(_stars(members), content, similarity, True)
    drop(members)
    links = stars.where("similar").select("a", "b")
    labels = connected_components(links, "near")
    rest = _check_pairs(_possible(stars, labels, similarity), content, similarity, False).where("similar").select("a", "b")
    if not rest.isEmpty():
        labels = connected_components(links.union(rest), "near")
    drop(content)
    drop(stars)
    return told.select("doc_id", "raw", "tid").join(labels, told["tid"] == labels["node"], "left").select("doc_id", "raw", F.coalesce("label", "tid").alias("label"))


def near_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row a document: ``doc_id, raw, class_id, class_size``.

    ``class_id`` is the least doc_id of the class, ``class_size`` its number of rows. Classes
    are the connected components of "same words" and "weighted Jaccard of the five-word
    shingle counts at least ``similarity``". Texts without words (null, empty, white space)
    form one class. A text of one to four words is one shingle. Repeated rows come back as
    often as they came. ``raw`` is a 64-bit hash of the text, which tells rows of one id apart.
    """
    placed = _placed(documents, doc_id, text, similarity)
    classes = placed.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return placed.join(classes, "label").select("doc_id", "raw", "class_id", "class_size")


def keep_first(documents: DataFrame) -> DataFrame:
    """The documents that are the first (least doc_id) of their class, columns unchanged.

    Of repeated rows and of texts that share the least id, one stays. A class without any
    doc_id keeps one row too.
    """
    placed = _placed(documents, "doc_id", "text", SIMILARITY)
    # Equal texts have one label, so it does not matter which row's is taken.
    alike = placed.groupBy("doc_id", "raw").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("rows"))
    # Nulls are the least in a struct, and a row with an id goes before one without.
    first = alike.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw", "rows")).alias("l"))
    first = materialise(first.select(F.col("l.doc_id").alias("keep_id"), F.col("l.raw").alias("keep_raw"), F.col("l.rows").alias("keep_rows")), "near-kept")
    # The row travels as one struct, so that no column of it can clash with a key.
    rows = documents.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(F.col("text")).alias("raw"), F.struct(*documents.columns).alias("row"))
    kept = rows.join(first, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("raw") == F.col("keep_raw")))
    if not first.where("keep_rows > 1").isEmpty():
        kept = kept.where("keep_rows = 1").unionByName(kept.where("keep_rows > 1").dropDuplicates(["keep_id", "keep_raw"]))
    return kept.select("row.*")


#: The same classes in DuckDB's SQL by comparing all pairs that share a shingle.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS g
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT r, g, count(*) AS c FROM s GROUP BY r, g),
t AS (SELECT r, sum(c) AS n FROM c GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, sum(least(x.c, y.c)) AS m FROM c x JOIN c y ON x.g = y.g AND x.r < y.r GROUP BY x.r, y.r),
e AS (SELECT a, b FROM p JOIN t x ON x.r = a JOIN t y ON y.r = b WHERE m >= {SIMILARITY} * (x.n + y.n - m) - 1e-9
      UNION SELECT (SELECT min(r) FROM d WHERE len(w) = 0), r FROM d WHERE len(w) = 0),
twoway AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(r, l) AS (SELECT r, r FROM d UNION SELECT reach.r, twoway.b FROM reach JOIN twoway ON twoway.a = reach.l),
class AS (SELECT reach.r, min(x.doc_id) AS class_id, count(DISTINCT l) AS class_size FROM reach JOIN d x ON x.r = reach.l GROUP BY reach.r)
SELECT doc_id, class_id, CAST(class_size AS BIGINT) AS class_size FROM d JOIN class USING (r)
"""
