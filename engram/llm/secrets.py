"""Secret scans, natively in the JVM: fixed patterns plus sliding-window entropy.

Positions of matches come from two built-ins that walk a text alike: the matches
themselves (``regexp_extract_all``) and the gaps between them (``split``). Running sums of
their lengths are the offsets, in code points.

The entropy part takes candidate strings, maximal runs of one character class, and slides
a window over each. Symbol counts and the sum of ``c * log2(c)`` are carried from window to
window: a step adds the entering symbol and takes the leaving one out. Sums are integers
(scaled by 2**20), so the order of steps cannot change a result. A candidate that looks
like an ordinary word, number, identifier or placeholder is on the allow list and dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.native import let, prefix_sums, sha256_hex

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
# A failing run of these two kinds never hides a longer one, so the length is in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

BASE_KINDS = ("assign", "access", "hex")
SCALE = 1 << 20
#: kind, class, symbols as they are counted, window, least bits a symbol
ENTROPY_CLASSES = (
    ("entropy_hex", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{20,}(?![0-9A-Za-z])", "0123456789abcdefABCDEF", 20, 3.0),
    ("entropy_base64", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 20, 3.6),
)
KINDS = (*BASE_KINDS, *(c[0] for c in ENTROPY_CLASSES))
#: Candidates that match one of these are no secrets.
ALLOWED = (
    r"^[A-Za-z/_+-]+$",
    r"^[0-9/_+-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|dummy|xxxx",
    r"^[a-z]+(?:[-_/][a-z0-9]{1,8})+$",
)
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
REDACTED = "[REDACTED]"


def _none() -> Column:
    return F.array().cast(SPAN)


def _rank(kind: str) -> Column:
    return F.lit(KINDS.index(kind)).cast("int")


def _span(start: Column, kind: str, end: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), _rank(kind).alias("kind"), end.cast("bigint").alias("end"))


def _found(text: Column, pattern: str, make, keep=None) -> Column:
    """``make(match, start, end)`` for every leftmost non-overlapping match that ``keep(i)`` admits."""

    def place(hits: Column, gaps: Column) -> Column:
        steps = F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i)))
        made = let(prefix_sums(steps), lambda ends: F.transform(hits, lambda h, i: make(h, F.get(ends, i) - F.length(h), F.get(ends, i))))
        return F.filter(made, keep) if keep else made

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    located = let(hits, lambda h: let(F.split(text, pattern, -1), lambda g: place(h, g)))
    return F.when(text.rlike(pattern), located)


def assign_spans(text: Column) -> Column:
    """Assignments whose value has at least ``ASSIGN_VALUE`` characters."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    spans = _found(text, ASSIGN, lambda h, s, e: _span(s, "assign", e))
    kept = let(values, lambda v: F.filter(spans, lambda x, i: F.length(F.get(v, i)) >= ASSIGN_VALUE))
    return F.coalesce(F.when(text.rlike(ASSIGN), kept), _none())


def _plain_spans(text: Column, kind: str, pattern: str) -> Column:
    return F.coalesce(_found(text, pattern, lambda h, s, e: _span(s, kind, e)), _none())


def _c_log_c(window: int) -> Column:
    return F.array(*[F.lit(round(c * math.log2(c) * SCALE) if c else 0).cast("bigint") for c in range(window + 2)])


def hot_windows(candidate: Column, symbols: str, window: int, least_bits: float) -> Column:
    """First start and last end of the windows of ``candidate`` with enough entropy, else null.

    A window's entropy is ``log2(window) - sum(c * log2 c) / window`` over its symbol counts.
    """
    most = math.floor((math.log2(window) - least_bits) * window * SCALE)
    table = _c_log_c(window)
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        F.array_repeat(F.lit(0), len(symbols)).alias("n"),
        zero.alias("s"),
        F.lit(-1).alias("first"),
        F.lit(-1).alias("last"),
    )

    def slide(chars: Column) -> Column:
        def code(i: Column) -> Column:
            return F.instr(F.lit(symbols), F.get(chars, i)) - 1

        def step(acc: Column, i: Column) -> Column:
            def update(enter: Column, leave: Column) -> Column:
                had = F.get(acc["n"], enter)
                into = acc["s"] + F.get(table, had + 1) - F.get(table, had)
                held = F.get(acc["n"], leave) + F.when(leave == enter, 1).otherwise(0)
                s = F.when(leave < 0, into).otherwise(into - F.get(table, held) + F.get(table, held - 1))
                n = F.transform(acc["n"], lambda c, j: c + F.when(j == enter, 1).otherwise(0) - F.when(j == leave, 1).otherwise(0))
                hot = (i >= window - 1) & (s <= most)
                return F.struct(
                    n.alias("n"),
                    s.cast("bigint").alias("s"),
                    F.when(hot & (acc["first"] < 0), i - (window - 1)).otherwise(acc["first"]).cast("int").alias("first"),
                    F.when(hot, i + 1).otherwise(acc["last"]).cast("int").alias("last"),
                )

            gone = F.when(i >= window, code(i - window)).otherwise(F.lit(-1))
            return let(code(i), lambda enter: let(gone, lambda leave: update(enter, leave)))

        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda acc: F.when(acc["first"] >= 0, F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))

    return let(F.split(candidate, ""), slide)


def _allowed(candidate: Column) -> Column:
    listed = F.lit(False)
    for pattern in ALLOWED:
        listed = listed | candidate.rlike(pattern)
    return listed


def entropy_spans(text: Column, kind: str, pattern: str, symbols: str, window: int, least_bits: float) -> Column:
    """Spans of the high-entropy stretches of the candidates of one class."""

    def make(h: Column, s: Column, e: Column) -> Column:
        hot = F.when(~_allowed(h), hot_windows(h, symbols, window, least_bits))
        return let(hot, lambda w: F.when(w.isNotNull(), _span(s + w["first"], kind, s + w["last"])))

    return F.coalesce(_found(text, pattern, make, keep=lambda x: x.isNotNull()), _none())


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds by start, then kind."""
    return F.sort_array(F.concat(assign_spans(text), _plain_spans(text, "access", ACCESS), _plain_spans(text, "hex", HEX)))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base_spans`` and ``secret_spans`` (arrays of start, kind, end) to every row.

    Spans are in code points, end exclusive, ordered by start and then by kind; they may
    overlap. A null or empty text has none. Other columns pass through unchanged; columns
    of these two names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = documents.withColumn("base_spans", base_spans(body))
    extra = [entropy_spans(body, *c) for c in ENTROPY_CLASSES]
    return found.withColumn("secret_spans", F.sort_array(F.concat(F.col("base_spans"), *extra)))


def redact(text: Column, spans: Column, mark: str = REDACTED) -> Column:
    """``text`` with every span replaced by ``mark``; overlapping spans become one."""

    def build(s: Column) -> Column:
        def seen(i: Column) -> Column:
            return F.when(i <= 0, F.lit(0).cast("bigint")).otherwise(F.array_max(F.transform(F.slice(s, F.lit(1), F.greatest(i, F.lit(1))), lambda x: x["end"])))

        def piece(x: Column, i: Column) -> Column:
            return let(
                seen(i),
                lambda upto: F.when(x["start"] < upto, F.lit("")).otherwise(
                    F.concat(F.substring(text, (upto + 1).cast("int"), (x["start"] - upto).cast("int")), F.lit(mark))
                ),
            )

        rest = F.substring(text, (seen(F.size(s)) + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.transform(s, piece), ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, build))


def redacted_documents(documents: DataFrame) -> DataFrame:
    """The documents with every secret in ``text`` replaced and ``n_chars`` counted anew.

    Columns keep their names, types and order; a null text stays null, and ``n_chars`` of an
    unchanged text is left as it was.
    """
    rows = documents.select(F.col("text"), F.struct(*documents.columns).alias("row"))
    found = scan_secrets(rows)
    changed = F.size("secret_spans") > 0
    text = F.when(changed, redact(F.col("text"), F.col("secret_spans"))).otherwise(F.col("text"))
    found = found.select("row", text.alias("new_text"), changed.alias("changed"))
    new = {"text": F.col("new_text")}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("changed"), F.length("new_text").cast(kind)).otherwise(F.col("row")["n_chars"])
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in documents.columns])


def secret_digest(documents: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, counts of the base kinds, base_sha256 and spans."""
    found = scan_secrets(documents.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE_KINDS], sha256_hex(spelled(F.col("base_spans"))).alias("base_sha256"), spelled(F.col("secret_spans")).alias("spans"))
