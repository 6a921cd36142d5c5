"""Exact removal of long repeated word sequences, found by recompression.

Recompression names the text in rounds. A round first replaces every run of equal symbols
by one symbol, then splits the alphabet in two halves by a bit of the symbol's name and
replaces every left-half symbol followed by a right-half symbol with one symbol for the
pair. A name is a 64-bit hash of what it stands for, so a run or pair has the same name
wherever it occurs. Whether a symbol stands at a place depends on a short stretch of words
around it, which is carried along as its support. A window of ``WINDOW`` words that holds a
symbol's whole support therefore has that symbol at that place wherever it occurs. The
highest symbols here are ``JOINED`` neighbours of the last round under one name.

Each window is anchored at the highest symbol whose support it holds (the least name of
those of one level), so windows with equal words have equal anchors. The search then goes
through rounds over all documents:

1. ``_chunks`` reads the texts once into a written table of chunks of documents, with the names
   of their anchors and of the stretches of windows under one anchor.
2. ``_shared`` brings equal anchors of all chunks together. A window whose anchor stands at one
   place only in all texts cannot repeat and is never looked at again. Where all stretches
   under an anchor have one name, all of their windows repeat.
3. ``_candidates`` names the windows of the other shared anchors, such as those where a passage
   begins or ends, by all their words; a window whose name stands at a second place repeats.
4. ``_kept`` removes the words.

Names of stretches and windows have 96 bits with their anchor's, so that among the 4e12
windows under shared anchors of 100 TB of text one false repeat is expected with a
probability of about 1e-4. A chunk counts each name once: a passage that a third of all
documents share meets in a round as a row a chunk, one of the tens of thousands of names of
that chunk, so that no name holds a noticeable share of the rows. A common anchor with many
different surroundings is spread over tasks by the names of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm.memory import tidied
from engram.sources.shared import materialise

WINDOW = 35
ROUNDS = 3
JOINED = 3
#: Words gathered before a chunk is closed; one longer document is a chunk of its own.
CHUNK_WORDS = 400_000
WORDS_KEPT = 150_000

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    """64-bit hash of each distinct word; restarted once it holds ``WORDS_KEPT``."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of anything but ASCII white space."""
    return (text or "").encode("utf-8").split()


def recompress(names: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after ``rounds`` rounds over concatenated documents: names, support starts, support ends.

    ``doc`` is the document of each word, ascending. A support that would reach beyond its
    document is put one word outside it, where no window holds it.
    """
    n = len(names)
    lo = np.arange(n, dtype=np.int64)
    hi = lo + 1
    edge = np.flatnonzero(np.diff(doc)) + 1
    first = np.zeros(int(doc[-1]) + 1 if n else 0, dtype=np.int64)
    last = np.zeros_like(first)
    if n:
        begins, ends = np.concatenate(([0], edge)), np.concatenate((edge, [n]))
        first[doc[begins]], last[doc[begins]] = begins, ends
    sym = names.copy()
    for r in range(rounds):
        # Runs of equal symbols.
        same = (sym[1:] == sym[:-1]) & (doc[1:] == doc[:-1])
        head = np.flatnonzero(np.concatenate(([True], ~same)))
        tail = np.concatenate((head[1:], [len(sym)])) - 1
        length = tail - head + 1
        d = doc[head]
        new_lo = np.where((head > 0) & (doc[np.maximum(head - 1, 0)] == d), lo[np.maximum(head - 1, 0)], first[d] - 1)
        after = np.minimum(tail + 1, len(sym) - 1)
        new_hi = np.where((tail + 1 < len(sym)) & (doc[after] == d), hi[after], last[d] + 1)
        sym = np.where(length > 1, mix(sym[head] + _A * length.astype(np.uint64) + np.uint64(2 * r)), sym[head])
        lo, hi, doc = new_lo, new_hi, d
        # Pairs across the two halves of the alphabet.
        right = (mix(sym + _C * np.uint64(r + 1)) >> np.uint64(63)).astype(bool)
        joined = doc[1:] == doc[:-1]
        pair = np.concatenate((joined & ~right[:-1] & right[1:], [False]))
        second = np.concatenate(([False], pair[:-1]))
        nxt = np.minimum(np.arange(len(sym)) + 1, len(sym) - 1)
        prv = np.maximum(np.arange(len(sym)) - 1, 0)
        has_next, has_prev = np.concatenate((joined, [False])), np.concatenate(([False], joined))
        lone_left, lone_right = ~right & ~pair, right & ~second
        hi_out = np.where(pair | lone_left, np.where(has_next, hi[nxt], last[doc] + 1), hi)
        lo_out = np.where(lone_right, np.where(has_prev, lo[prv], first[doc] - 1), lo)
        sym = np.where(pair, mix(mix(sym + _A) + sym[nxt] * _B + np.uint64(2 * r + 1)), sym)
        keep = ~second
        sym, lo, hi, doc = sym[keep], lo_out[keep], hi_out[keep], doc[keep]
    return sym, lo, hi


def window_hashes(names: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A hash of the ``window`` names from each place on; documents are not heeded."""
    n = len(names)
    if n < window:
        return np.zeros(0, dtype=np.uint64)
    powers = {1: _A}
    block, size = names, 1
    total, covered = None, 0
    left = window
    while left:
        if left & 1:
            part = block[covered : covered + n - window + 1]
            total = part.copy() if total is None else total * powers[size] + part
            covered += size
        left >>= 1
        if left:
            block = block[:-size] * powers[size] + block[size:]
            powers[2 * size] = powers[size] * powers[size]
            size *= 2
    return mix(total)


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Index of the least value in each ``[begin, end)``, the first of equals; ranges are not empty."""
    levels = [np.arange(len(values))]
    widest = int((end - begin).max())
    while (1 << len(levels)) <= widest:
        step = 1 << (len(levels) - 1)
        a, b = levels[-1][:-step], levels[-1][step:]
        levels.append(np.where(values[b] < values[a], b, a))
    level = np.frexp((end - begin).astype(np.float64))[1] - 1
    out = np.empty(len(begin), dtype=np.int64)
    for k, table in enumerate(levels):
        at = np.flatnonzero(level == k)
        if len(at):
            a, b = table[begin[at]], table[end[at] - (1 << k)]
            out[at] = np.where(values[b] < values[a], b, a)
    return out


def anchors(names: np.ndarray, lengths: np.ndarray, rounds: int = ROUNDS, joined: int = JOINED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows start, and their stretches of one anchor: ``(places, sizes, symbols)``.

    Windows that follow one another and are anchored at the same symbol of one document are
    a stretch. Levels from the top: ``joined``, two and one symbol of the last round, then
    single words, of which every window has one.
    """
    doc = np.repeat(np.arange(len(lengths)), lengths)
    places = places_of(lengths)
    if not len(places):
        return places, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    name, at = np.zeros(len(places), dtype=np.uint64), np.full(len(places), -1, dtype=np.int64)
    todo = np.arange(len(places))
    base = (names, np.arange(len(names)), np.arange(len(names)) + 1)
    top = recompress(names, doc, rounds)
    for level, ((sym, lo, hi), m) in enumerate([(top, m) for m in range(joined, 0, -1)] + [(base, 1)]):
        n = len(sym) - m + 1
        if not len(todo) or n < 1:
            continue
        whole = mix(sym[:n] + _C * np.uint64(level))
        for j in range(1, m):
            whole = mix(whole * _A + sym[j : n + j])
        first, last = np.searchsorted(lo[:n], places[todo], "left"), np.searchsorted(hi[m - 1 :], places[todo] + WINDOW, "right")
        has = last > first
        if has.any():
            best = _least(mix(whole * _B + _A), first[has], last[has])
            # The level is part of the place: two levels may have a symbol that starts at one word.
            name[todo[has]], at[todo[has]] = whole[best], lo[best] * (joined + 2) + level
        todo = todo[~has]
    new = np.ones(len(places), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(places) != 1)
    start = np.flatnonzero(new)
    return places, np.diff(np.append(start, len(places))), name[start]


def places_of(lengths: np.ndarray) -> np.ndarray:
    """Where windows start in documents of so many words, one after the other."""
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    return np.flatnonzero(np.arange(n) + WINDOW <= np.repeat(ends, lengths))


def stretch_names(names: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 32-bit name of all windows of each stretch, in their order."""
    if not len(places):
        return np.zeros(0, dtype=np.int32)
    begin = np.cumsum(sizes) - sizes
    number = (np.arange(len(places)) - np.repeat(begin, sizes)).astype(np.uint64)
    whole = mix(np.add.reduceat(mix(window_hashes(names)[places] + _A * number), begin))
    return (whole >> np.uint64(32)).astype(np.uint32).view(np.int32)


class _Codes(dict):
    """Code of each distinct word, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _names(words: list[bytes]) -> np.ndarray:
    """Names of words; each distinct one is hashed once."""
    codes = _Codes()
    at = np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words))
    return np.array([xxhash.xxh3_64_intdigest(w) for w in codes], dtype=np.uint64)[at] if words else np.zeros(0, dtype=np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=6)
    partition = TaskContext.get().partitionId()
    ids, words, lengths = [], [], []
    made = 0

    def flush() -> pa.RecordBatch:
        nonlocal made
        names, sizes_of = _names(words), np.array(lengths, dtype=np.int64)
        places, sizes, symbols = anchors(names, sizes_of)
        prints = stretch_names(names, places, sizes)
        # Distinct anchors in order of their first place; an anchor's stretches follow as steps in that list.
        distinct, first, where, times = np.unique(symbols, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(first)
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order))
        where = rank[where]
        print_of = prints[first[order]]
        uniform = np.ones(len(order), dtype=bool)
        uniform[where[prints != print_of[where]]] = False
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([(partition << 32) + made], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(ids)),
                pa.array([sizes_of], pa.list_(pa.int64())),
                pa.array([squeeze.compress(b" ".join(words))], pa.binary()),
                pa.array([squeeze.compress(sizes.astype(np.int32).tobytes())], pa.binary()),
                pa.array([squeeze.compress(np.diff(where, prepend=0).astype(np.int32).tobytes())], pa.binary()),
                pa.array([distinct[order].view(np.int64)], pa.list_(pa.int64())),
                pa.array([print_of], pa.list_(pa.int32())),
                # 1: one stretch here, 2: several with one name, 3: several with different names.
                pa.array([np.where(times[order] == 1, 1, np.where(uniform, 2, 3)).astype(np.int8)], pa.list_(pa.int8())),
            ],
            names=["chunk", "ids", "lengths", "text", "sizes", "anchor", "symbols", "prints", "times"],
        )
        made += 1
        ids.clear(), words.clear(), lengths.clear()
        return out

    with np.errstate(over="ignore"):
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                more = words_of(text.as_py())
                ids.append(batch.column("doc_id").slice(i, 1))
                words += more
                lengths.append(len(more))
                # A document without words counts too, so that a chunk of them is bounded.
                if len(words) + 10 * len(lengths) >= CHUNK_WORDS:
                    yield flush()
        if ids:
            yield flush()


def _shared(chunks: DataFrame) -> DataFrame:
    """``chunk, whole, open``: anchors (as places in the chunk's list) that stand at two places or more.

    Under those in ``whole`` all stretches are equal, under those in ``open`` they are not.
    """
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("symbols", "prints", "times")).alias("i", "s")).select("chunk", "i", "s.*")
    w = Window.partitionBy("symbols")
    seen = F.sum(F.least("times", F.lit(2))).over(w)
    mixed = (F.max("times").over(w) == 3) | (F.min("prints").over(w) != F.max("prints").over(w))
    found = each.select("chunk", "i", seen.alias("seen"), mixed.alias("mixed")).where("seen > 1")
    return found.groupBy("chunk").agg(F.collect_list(F.when(~F.col("mixed"), F.col("i"))).alias("whole"), F.collect_list(F.when(F.col("mixed"), F.col("i"))).alias("open"))


class _Chunk:
    """A chunk read back: its words, where its windows start, and the anchor of each."""

    def __init__(self, batch: pa.RecordBatch, i: int, widen: zstandard.ZstdDecompressor):
        get = lambda name: widen.decompress(batch.column(name)[i].as_py())
        self.words = get("text").split(b" ") if batch.column("text")[i].as_py() else []
        self.lengths = np.asarray(batch.column("lengths")[i].values, dtype=np.int64)
        if not self.lengths.sum():
            self.words = []
        self.places = places_of(self.lengths)
        sizes = np.frombuffer(get("sizes"), dtype=np.int32)
        self.anchor = np.repeat(np.cumsum(np.frombuffer(get("anchor"), dtype=np.int32)), sizes)

    def under(self, anchors: np.ndarray) -> np.ndarray:
        """The windows under some of the chunk's anchors."""
        if not len(self.anchor):
            return self.places
        wanted = np.zeros(int(self.anchor.max()) + 1, dtype=bool)
        wanted[anchors] = True
        return self.places[wanted[self.anchor]]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    widen, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    columns = ["first", "second", "chunk", "place", "known"]
    with np.errstate(over="ignore"):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, number = _Chunk(batch, i, widen), batch.column("chunk")[i].as_py()
                places = chunk.under(np.asarray(batch.column("open")[i].values))
                if not len(places):
                    continue
                names = _names(chunk.words)
                first, second = window_hashes(names)[places], window_hashes(mix(names + _C))[places]
                order = np.lexsort((places, second, first))
                f, s = first[order], second[order]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
                head = np.flatnonzero(new)
                times = np.diff(np.append(head, len(order)))
                # Windows that repeat inside the chunk are told at once; one of each goes on to the round, marked by a negative place.
                known = np.sort(places[order[np.repeat(times > 1, times)]])
                one = np.sort(order[head])
                twice = np.zeros(len(order), dtype=bool)
                twice[order[head[times > 1]]] = True
                place = np.where(twice[one], -1 - places[one], places[one]).astype(np.int32)
                rows = [first[one].view(np.int64), (second[one] >> np.uint64(32)).astype(np.uint32).view(np.int32), np.full(len(one), number), place, [None] * len(one)]
                whole = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=columns)
                for lo in range(0, whole.num_rows, 50_000):
                    yield whole.slice(lo, 50_000)
                if len(known):
                    steps = np.diff(known, prepend=0).astype(np.int32).tobytes()
                    told = [[number * 31 + 7], [0], [number], [None], [squeeze.compress(steps)]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(told, kinds)], names=columns)


def _repeated(chunks: DataFrame, shared: DataFrame) -> DataFrame:
    """``chunk, places, known``: the repeated windows under the open anchors of each chunk that has some."""
    rows = chunks.select("chunk", "lengths", "text", "sizes", "anchor").join(shared.where(F.size("open") > 0).select("chunk", "open"), "chunk")
    named = rows.mapInArrow(tidied(_candidates), "first bigint, second int, chunk bigint, place int, known binary")
    seen = F.sum(F.when(F.col("place") < 0, 2).otherwise(1)).over(Window.partitionBy("first", "second"))
    found = named.withColumn("seen", seen).where("known is not null or (seen > 1 and place >= 0)")
    return found.groupBy("chunk").agg(F.collect_list("place").alias("places"), F.max("known").alias("known"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    widen = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            chunk = _Chunk(batch, i, widen)
            edges = np.zeros(len(chunk.words) + 1, dtype=np.int32)
            # A window is under one anchor and in one of the three lists only.
            marks = []
            if batch.column("whole")[i].is_valid:
                marks.append(chunk.under(np.asarray(batch.column("whole")[i].values)))
            if batch.column("places")[i].is_valid:
                marks.append(np.asarray(batch.column("places")[i].values, dtype=np.int64))
            if batch.column("known")[i].is_valid:
                marks.append(np.cumsum(np.frombuffer(widen.decompress(batch.column("known")[i].as_py()), dtype=np.int32), dtype=np.int64))
            for at in marks:
                edges[at] += 1
                edges[at + WINDOW] -= 1
            gone = np.cumsum(edges[:-1]) > 0
            ids = batch.column("ids")[i].values
            ends = np.cumsum(chunk.lengths)
            removed = np.concatenate(([0], np.cumsum(gone)))
            removed = removed[ends] - removed[ends - chunk.lengths]
            for lo in range(0, len(ends), 256):
                kept = []
                for d in range(lo, min(lo + 256, len(ends))):
                    a, b = int(ends[d] - chunk.lengths[d]), int(ends[d])
                    kept.append(b" ".join([chunk.words[j] for j in (a + np.flatnonzero(~gone[a:b])).tolist()] if removed[d] else chunk.words[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(kept)), pa.array(chunk.lengths[lo : lo + 256]), pa.array(removed[lo : lo + 256], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Drops every word covered by a ``WINDOW``-word sequence that starts anywhere else too.

    Returns ``doc_id``, ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by
    one space), one row for each input row; other columns are left out, whatever their
    names. All occurrences go, also those in one document and in repeated rows, which are
    documents of their own. Null and empty texts have no words and an empty table gives
    none. Windows are judged on the input. A text of any length is one document in one
    chunk.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    made = T.StructType(
        [T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType()))]
        + [T.StructField(c, T.BinaryType()) for c in ("text", "sizes", "anchor")]
        + [T.StructField("symbols", T.ArrayType(T.LongType())), T.StructField("prints", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.ByteType()))]
    )
    chunks = materialise(rows.mapInArrow(tidied(_chunks), made), "repeat-chunks")
    shared = materialise(_shared(chunks), "repeat-shared")
    marks = shared.select("chunk", "whole").join(_repeated(chunks, shared), "chunk", "left")
    joined = chunks.select("chunk", "ids", "lengths", "text", "sizes", "anchor").join(marks, "chunk", "left")
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(tidied(_kept), out)


#: The same result in DuckDB's SQL, window by window.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) AS h
        FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM win WHERE h IN (SELECT h FROM twice)),
word AS (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT word.r, string_agg(t, ' ' ORDER BY i) AS k, count(*) AS n FROM word ANTI JOIN gone USING (r, i) GROUP BY word.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""
