"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are compared as normalised words. Every run of ``SEED`` words of
an item (all of a shorter one) is a seed; a document that shares none is clean at once, and an item whose shared
seeds together could not reach the coverage asked for is dropped before any tiling. For the
items left, running Karp-Rabin greedy string tiling marks the longest common runs of words
that overlap no run marked before, down to ``SEED`` words. The share of the item that is
marked is its coverage, which sentences in another order do not lower.

The benchmark is read in blocks of at most ``BLOCK_WORDS`` words; one block at a time is
broadcast, and every document is held against every block. Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm.memory import tidied
from engram.llm.substring_dedup import window_hashes
from engram.sources.shared import materialise

SEED = 4
COVERAGE = 0.5
BLOCK_WORDS = 2_000_000
FIRST_SEARCH = 20
WORDS_KEPT = 150_000
UNKNOWN = -1

_NOT_WORD = re.compile(r"[\W_]+")


def normalised(word: str) -> str:
    """Lower case, letters and digits only; ``""`` for a word of marks alone."""
    return _NOT_WORD.sub("", word.lower())


def _hashes(codes: np.ndarray, open_: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and running Karp-Rabin hashes of the stretches of ``s`` open symbols."""
    if len(codes) < s:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    shut = np.concatenate(([0], np.cumsum(~open_)))
    at = np.flatnonzero(shut[s:] == shut[:-s])
    with np.errstate(over="ignore"):
        return at, window_hashes((codes + 2).astype(np.uint64), s)[at]


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))).tolist()
    return list(zip(edges[::2], edges[1::2]))


def maximal_runs(item: np.ndarray, text: np.ndarray, open_i: np.ndarray, open_t: np.ndarray, s: int) -> np.ndarray:
    """Rows ``-length``, ``item start`` and ``text start`` of the common runs of ``s`` open symbols or more that cannot grow.

    Equal hashes on one diagonal that follow one another are one run, which is compared word
    by word once, so a text of one repeated word costs no more than its places times the item's.
    """
    at_i, hash_i = _hashes(item, open_i, s)
    at_t, hash_t = _hashes(text, open_t, s)
    if not len(at_i) or not len(at_t):
        return np.zeros((3, 0), dtype=np.int64)
    hit = np.isin(hash_t, hash_i)
    at_t, hash_t = at_t[hit], hash_t[hit]
    order = np.argsort(hash_t, kind="stable")
    begin, end = np.searchsorted(hash_t[order], hash_i, "left"), np.searchsorted(hash_t[order], hash_i, "right")
    runs: list[np.ndarray] = [np.zeros((3, 0), dtype=np.int64)]
    # Of each diagonal (text place minus item place, from -len(item)): where its run began, and the last item place with a hit.
    since = np.full(len(item) + len(text), -1, dtype=np.int64)
    seen = np.full(len(item) + len(text), -1, dtype=np.int64)
    live = np.zeros(0, dtype=np.int64)

    def close(diagonals: np.ndarray, until: int) -> None:
        p, d = since[diagonals], diagonals - len(item)
        since[diagonals] = -1
        k = until - p + s - 1
        begins = np.cumsum(k) - k
        at = np.arange(k.sum()) - np.repeat(begins - p, k)
        same = item[at] == text[at + np.repeat(d, k)]
        good = np.logical_and.reduceat(same, begins)
        runs.append(np.stack((-k, p, p + d))[:, good])
        for n in np.flatnonzero(~good).tolist():
            edges = _stretches(same[begins[n] : begins[n] + k[n]])
            runs.extend(np.array([[lo - hi], [p[n] + lo], [p[n] + d[n] + lo]]) for lo, hi in edges if hi - lo >= s)

    before = -2
    for n, place in enumerate(at_i.tolist()):
        if place != before + 1 and len(live):
            close(live, before + 1)
            live = live[:0]
        now = at_t[order[begin[n] : end[n]]] + (len(item) - place)
        if len(live) or len(now):
            seen[now] = place
            ended = live[seen[live] != place]
            if len(ended):
                close(ended, place)
            since[now[since[now] < 0]] = place
            live = now
        before = place
    if len(live):
        close(live, before + 1)
    return np.concatenate(runs, axis=1)


def tiles(item: list[int], text: list[int], least: int = SEED, first: int = FIRST_SEARCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(item start, text start, length)`` of the marked runs.

    Unknown words (negative) match nothing. Always the longest run that overlaps no marked
    one is marked next; among runs of one length the one that starts first in the item, then
    in the text. The search goes down from runs of ``first`` words to ``least``.
    """
    a, b = np.asarray(item, dtype=np.int64), np.asarray(text, dtype=np.int64)
    open_i, open_t = a >= 0, b >= 0
    found: list[tuple[int, int, int]] = []
    s = max(least, first)
    while True:
        runs = maximal_runs(a, b, open_i, open_t, s)
        runs = runs[:, np.lexsort(runs[::-1])]
        rest: list[tuple[int, int, int]] = []
        at = vain = 0
        while at < runs.shape[1] or rest:
            if vain > 2000:
                # Runs without s open words on both sides go at once.
                k, p, t = runs = runs[:, at:]
                in_item, in_text = (np.concatenate(([0], np.cumsum(x))) for x in (open_i, open_t))
                runs = runs[:, (in_item[p - k] - in_item[p] >= s) & (in_text[t - k] - in_text[t] >= s)]
                at = vain = 0
                continue
            head = tuple(runs[:, at].tolist()) if at < runs.shape[1] else None
            if head is None or (rest and rest[0] < head):
                k, p, t = heappop(rest)
            else:
                (k, p, t), at = head, at + 1
            k = -k
            free = open_i[p : p + k] & open_t[t : t + k]
            if free.all():
                open_i[p : p + k] = open_t[t : t + k] = False
                found.append((p, t, k))
                if not any(hi - lo >= s for lo, hi in _stretches(open_i)):
                    break
                continue
            vain += 1
            # What marked runs have left of it is a run of its own.
            if np.count_nonzero(free) >= s:
                for lo, hi in _stretches(free):
                    if hi - lo >= s:
                        heappush(rest, (lo - hi, p + lo, t + lo))
        if s == least:
            return found
        s = max(least, s // 2)


class _Block:
    """Words and seeds of one block of the benchmark.

    ``seeds`` has, for each length of seed, the sorted seed hashes with their item and their
    place in it. An item of fewer than ``SEED`` words is its own seed.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.items: list[np.ndarray] = []
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for n, (_, text) in enumerate(items):
            words = [w for w in map(normalised, text.split()) if w]
            codes = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], dtype=np.int64)
            self.items.append(codes)
            if len(codes):
                m = min(SEED, len(codes))
                hashes = seed_hashes(codes, m)
                parts[m].append((hashes, np.full(len(hashes), n), np.arange(len(hashes))))
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m, some in parts.items():
            hashes, owner, where = (np.concatenate(x) for x in zip(*some))
            order = np.argsort(hashes, kind="stable")
            self.seeds[m] = hashes[order], owner[order], where[order]


def seed_hashes(codes: np.ndarray, m: int = SEED) -> np.ndarray:
    with np.errstate(over="ignore"):
        return window_hashes((codes + 2).astype(np.uint64), m)


class _Codes(dict):
    """Code of each raw word in a block's vocabulary; None for words of marks alone."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int | None:
        plain = normalised(word)
        code = self.vocabulary.get(plain, UNKNOWN) if plain else None
        if len(word) <= 64:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = code
        return code


def _leaks(codes: np.ndarray, block: _Block, coverage: float) -> list[tuple[int, float]]:
    """Items of ``block`` that ``codes`` covers to ``coverage`` at least, with their coverage."""
    out = []
    for m, (seeds, owner, where) in block.seeds.items():
        if len(codes) < m:
            continue
        hashes = seed_hashes(codes, m)
        begin = np.searchsorted(seeds, hashes, "left")
        hit = np.flatnonzero(seeds[np.minimum(begin, len(seeds) - 1)] == hashes)
        if not len(hit):
            continue
        # A seed that the text repeats meets an item once for the reach, and at each place for the text.
        begin = begin[hit]
        n = np.searchsorted(seeds, hashes[hit], "right") - begin
        row = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(hit, n)
        order = np.argsort(owner[row], kind="stable")
        row, at = row[order], at[order]
        edges = np.flatnonzero(np.diff(owner[row])) + 1
        for mine, places in zip(np.split(row, edges), np.split(at, edges)):
            item = block.items[owner[mine[0]]]
            reach = np.zeros(len(item), dtype=bool)
            inside = np.zeros(len(codes), dtype=bool)
            for k in range(m):
                reach[where[mine] + k] = True
                inside[places + k] = True
            if reach.sum() < coverage * len(item) - 1e-9:
                continue
            # Only words inside a shared seed can be tiled; each stretch between becomes one unknown.
            keep = np.flatnonzero(inside)
            gaps = np.flatnonzero(np.diff(keep) != 1) + 1
            text = np.insert(codes[keep], gaps, UNKNOWN)
            covered = sum(k for _, _, k in tiles(item, text, least=m))
            if covered >= coverage * len(item) - 1e-9:
                out.append((block.ids[owner[mine[0]]], covered / len(item)))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[_Block]:
    items: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).toLocalIterator():
        items.append((row.i, row.t))
        size += row.t.count(" ") + 1
        if size >= BLOCK_WORDS:
            yield _Block(items)
            items, size = [], 0
    if items:
        yield _Block(items)


def find_leaks(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds ``leaks``: an array of ``item_id, coverage`` of the items that each document holds.

    An item counts when at least ``coverage`` of its words are tiled, by runs of ``SEED``
    words or more; a shorter item counts where its whole text stands. Items without words
    and null or empty texts never match; an empty benchmark leaves every array empty, an
    empty table stays empty. Texts of any length are searched whole. Items of one id are
    told one by one. Leaks are ordered by item id; other columns pass through, and a column
    of that name is replaced. Rows come back as often as they came. Where the benchmark has
    more than one block, the result after each block is written, so that one is held at a time.
    """
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType())]))
    found = documents.withColumn("leaks", F.array().cast(kind))
    names = [n for n in found.columns if n != "leaks"]
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())]))
    schema = T.StructType([*[f for f in found.schema.fields if f.name != "leaks"], T.StructField("leaks", kind)])
    held = None
    for n, built in enumerate(_blocks(benchmark, item_id, item_text)):
        if n:
            found = materialise(found, "leaks-found")
            held.destroy()
        held = documents.sparkSession.sparkContext.broadcast(built)

        def run(batches: Iterator[pa.RecordBatch], shared=held) -> Iterator[pa.RecordBatch]:
            block = shared.value
            code = _Codes(block.vocabulary)
            for whole in batches:
                for lo in range(0, whole.num_rows, 1024):
                    batch = whole.slice(lo, 1024)
                    leaks = []
                    for value, before in zip(batch.column(text), batch.column("leaks").to_pylist()):
                        words = [c for c in map(code.__getitem__, (value.as_py() or "").split()) if c is not None]
                        now = [{"item_id": i, "coverage": c} for i, c in _leaks(np.array(words, dtype=np.int64), block, coverage)]
                        leaks.append(sorted((before or []) + now, key=lambda x: (x["item_id"] is None, x["item_id"])))
                    yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(leaks, arrow)], names=[*names, "leaks"])

        found = found.select(*names, "leaks").mapInArrow(tidied(run), schema)
    return found


def leak_pairs(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, coverage."""
    found = find_leaks(documents.select("doc_id", "text"), benchmark, coverage)
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", F.round("l.coverage", 6).alias("coverage"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold no item; columns unchanged, also one named ``leaks``."""
    rows = documents.select("text", F.struct(*documents.columns).alias("row"))
    return find_leaks(rows, benchmark, coverage).where(F.size("leaks") == 0).select("row.*")
