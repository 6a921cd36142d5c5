"""Spelling variants: words one edit apart, found through their halves.

Of two words that differ by one inserted, deleted or replaced code point one half of the first
stands unchanged in the second, at its start or at its end. Every word is sent to the shards of
its own two halves and of the other two that a word one longer or shorter could share with it.
A shard's automaton holds the halves of its words; it scans each word once, a hit counts where
the half stands at the start or the end and the lengths differ by one at most, and the rest of
both words is verified.

A half that more than ``HOT`` words share is not one shard's work: those words go on without
it, and the halves of what is left of them take its place, as often as needed.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.memory import tidy
from engram.sources.shared import drop, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: Every this many occurrences one loses a code point.
EVERY = 31
#: A word's form occurs at least this many times as often as the word.
TIMES = 10
#: Rows that share a half before they are split by the halves of their rests.
HOT = 20_000
#: Rows of a shard, about.
SHARD_ROWS = 40_000
START, END = 0, 1
#: Letters of runs are none of these; they bound a word and its path in a shard's automaton.
MARK, EDGE = "\x01", "\x02"


def word_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: the words of whole texts with their occurrences, after one in ``EVERY`` lost a code point.

    Null texts have no words; a null id is written as an empty text. Repeated rows count again.
    """
    # A run that is too short stays too short; longer ones are matched whole, as matching is greedy.
    runs = F.regexp_extract_all(F.col(text), F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{LEAST_LENGTH},}})"), F.lit(1))
    rows = documents.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("r"))
    rows = rows.select("d", F.translate("r", UPPER, LOWER).alias("r"))
    rows = rows.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "r").cast("binary")))
    k = (F.col("h") % F.length("r")).cast("int")
    cut = F.concat(F.substring(F.col("r"), F.lit(1), k), F.substring(F.col("r"), k + 2, F.length("r")))
    words = rows.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("r")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _halves(rest: Column) -> Column:
    """Own halves of ``rest`` and those of rests one longer or shorter: ``side, size, half``, distinct.

    The first half of n code points has n div 2, the second the others.
    """
    n = F.length(rest)
    firsts = F.array_distinct(F.array(F.floor((n - 1) / 2), F.floor(n / 2), F.floor((n + 1) / 2)))
    lasts = F.array_distinct(F.array(F.ceil((n - 1) / 2), F.ceil(n / 2), F.ceil((n + 1) / 2)))
    start = F.transform(firsts, lambda k: F.struct(F.lit(START).alias("side"), k.cast("int").alias("size"), F.substring(rest, F.lit(1), k.cast("int")).alias("half")))
    end = F.transform(lasts, lambda k: F.struct(F.lit(END).alias("side"), k.cast("int").alias("size"), F.substring(rest, (n - k + 1).cast("int"), k.cast("int")).alias("half")))
    return F.filter(F.concat(start, end), lambda x: x["size"] <= n)


def _split(rows: DataFrame) -> DataFrame:
    """Rows ``path, rest, word, n`` once for each half under which they may meet another."""
    return rows.select("path", "rest", "word", "n", F.explode(_halves(F.col("rest"))).alias("h")).select("path", "rest", "word", "n", "h.side", "h.size", "h.half")


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: every ordered pair of ``words(word, n)`` one edit apart, once."""
    keys = ["path", "side", "half"]
    rows, ready = words.select(F.lit("").alias("path"), F.col("word").alias("rest"), "word", "n"), []
    while True:
        dealt = materialise(_split(rows), "spelling-halves")
        hot = materialise(dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > HOT).drop("_rows"), "spelling-hot")
        if hot.isEmpty():
            ready.append(dealt)
            break
        # What has at most two code points left stays, which is few words a half; what has two or
        # more goes on, so that two words whose rests differ by one in length still meet.
        over = F.length("rest") - F.col("size")
        shared = dealt.join(hot, keys, "left_semi")
        ready.append(dealt.join(hot, keys, "left_anti").unionByName(shared.where((over <= 2) | (F.col("size") == 0))))
        deeper = shared.where((over >= 2) & (F.col("size") > 0)).withColumn("path", F.concat("path", F.lit(MARK), F.col("side").cast("string"), "half"))
        left = F.when(F.col("side") == START, F.substring(F.col("rest"), F.col("size") + 1, F.length("rest"))).otherwise(F.substring(F.col("rest"), F.lit(1), F.length("rest") - F.col("size")))
        rows = deeper.withColumn("rest", left).select("path", "rest", "word", "n")
    whole = ready[0]
    for part in ready[1:]:
        whole = whole.unionByName(part)
    shards = max(1, words.count() * 4 // SHARD_ROWS)
    placed = whole.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)))
    found = placed.repartition(shards, "shard").groupBy("shard").applyInArrow(_search, "word string, near string, near_n bigint")
    return found.dropDuplicates(["word", "near"])


def automaton_of(halves: dict[tuple[str, int, str], list[int]]):
    """Automaton of a shard's halves, keyed by path and half; a first half follows the edge, a last one comes before it."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for key in halves:
        path, side, half = key
        made.add_word(path + EDGE + half if side == START else half + EDGE + path, key)
    made.make_automaton()
    return made


def _search(shard: pa.Table) -> pa.Table:
    """Pairs one edit apart of the words under each half of a shard."""
    paths, rests, names, counts, sides, sizes, halves = (shard.column(c).to_pylist() for c in ("path", "rest", "word", "n", "side", "size", "half"))
    own: dict[tuple[str, int, str], list[int]] = defaultdict(list)
    scanned: dict[tuple[str, str], int] = {}
    for i, (path, rest) in enumerate(zip(paths, rests)):
        scanned.setdefault((path, rest), i)
        if sizes[i] == (len(rest) // 2 if sides[i] == START else len(rest) - len(rest) // 2):
            own[path, sides[i], halves[i]].append(i)
    out: dict[tuple[str, str], int] = {}
    if own:
        automaton = automaton_of(own)
        meet: dict[tuple[str, int, str], list[int]] = {}
        for (path, rest), i in scanned.items():
            begin = len(path) + 1
            for end, key in automaton.iter(path + EDGE + rest + EDGE + path):
                # Offset: a first half right after the path, a last one right before it.
                at = end - len(key[2]) + 1 if key[1] == START else end - len(path) - len(key[2])
                if key[0] == path and at == (begin if key[1] == START else begin + len(rest) - len(key[2])):
                    meet.setdefault(key, []).append(i)
        for key, others in meet.items():
            for i, j in one_edit(own[key], others, rests, key[1], len(key[2])):
                out[names[j], names[i]] = counts[i]
    tidy()
    return pa.table([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string()), pa.array(out.values(), pa.int64())], names=["word", "near", "near_n"])


def one_edit(own: list[int], others: list[int], rests: list[str], side: int, size: int):
    """Pairs of a word of ``own`` and one of ``others`` under a half whose rests are one edit apart.

    Words of ``own`` are filed by what is left of them, and by that with one code point out;
    each other word looks up the same of itself, so that words of other lengths than one more or
    less never meet, and a pair that comes up is one edit apart.
    """
    left = (lambda r: r[size:]) if side == START else (lambda r: r[: len(r) - size])
    whole: dict[str, list[int]] = defaultdict(list)
    holed: dict[tuple[int, str], list[int]] = defaultdict(list)
    shorter: dict[str, list[int]] = defaultdict(list)
    for i in own:
        x = left(rests[i])
        whole[x].append(i)
        cuts = [x[:p] + x[p + 1 :] for p in range(len(x))]
        for p, cut in enumerate(cuts):
            holed[p, cut].append(i)
        for cut in set(cuts):
            shorter[cut].append(i)
    for j in others:
        y = left(rests[j])
        cuts = [y[:p] + y[p + 1 :] for p in range(len(y))]
        found = [holed[key] for key in enumerate(cuts) if key in holed]
        found += [whole[cut] for cut in set(cuts) if cut in whole]
        found += [shorter[y]] if y in shorter else []
        for i in set(chain.from_iterable(found)):
            if rests[i] != rests[j]:
                yield i, j


def spelling_forms(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word.

    ``form`` is the near word with the most occurrences (ties: the first in code-point order)
    if it has ``TIMES`` those of the word; ``root`` follows forms to the last. A form occurs ten
    times as often, so chains are short: each round follows twice as many steps. Empty tables and
    texts without words give no rows; columns other than the two named are not read.
    """
    words = materialise(word_counts(documents, doc_id, text), "spelling-words")
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(near, "word", "left")
    good = -F.col("best.less") >= TIMES * F.col("n")
    told = materialise(
        joined.select(
            "word", F.when(good, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(good, -F.col("best.less")).alias("form_n")
        ),
        "spelling-forms",
    )
    steps = materialise(told.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = materialise(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        moved = not further.where("moved").isEmpty()
        drop(steps)
        steps = further.drop("moved")
        if not moved:
            break
    return told.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB: crc32 by its table of 256 remainders, words joined by what is left without one code point.
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT i, i AS v, 0 AS step FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE step = 8),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
code AS (SELECT r, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM run),
hashed AS (SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
  lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS h FROM code, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN left(r, (h % len(r))::BIGINT) || substr(r, (h % len(r))::BIGINT + 2) ELSE r END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM made WHERE len(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (SELECT word, n, p, left(word, p) || substr(word, p + 2) AS c FROM (SELECT word, n, unnest(range(len(word))) AS p FROM words)),
pair AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.c = b.c AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.c = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.c = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most, arg_min(near, (-near_n, near)) AS near FROM pair GROUP BY word),
told AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN near END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at, form AS next FROM told UNION ALL SELECT walk.word, told.word, told.form FROM walk JOIN told ON told.word = walk.next)
SELECT told.word, told.form, walk.at AS root, n, n_near, form_n FROM told JOIN walk ON walk.word = told.word AND walk.next IS NULL
"""
