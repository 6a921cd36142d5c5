"""String functions of the fact store as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The standard 33-word English stop list.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
#: Query operator characters that are blanked out of a keyword query.
OPERATOR_CHARS = "+-!&|(){}[]^~*?:\\/\"'"
#: A keyword's bytes, names of the user's own node, labels of entity types.
LONGEST_TOKEN_BYTES = 40
HUB_NAMES = ("the user", "user")
ENTITY_LABELS = {"person": "person", "organization": "organization", "organisation": "organization", "project": "project", "location": "location"}
SNIPPET_CHARS = 80
MAX_ERROR_BYTES = 4096
RERANK_CHARS = 2000

#: Fixed values of the canonical form. Longer prefixes of one start come first.
ASKED = ("When the user was asked, ", "When the user was asked ", "When asked, ", "When asked ")
TOLD = ("told me ", "said ", "mentioned ", "stated ")
OPINIONS = ("I think ", "I believe ", "I learned ", "I noticed ", "I observed ")
FIRST_PERSON = {"I prefer ": "prefers", "I like ": "likes", "I love ": "loves", "I hate ": "hates", "I use ": "uses", "I want ": "wants", "I need ": "needs"}


def words(text: Column) -> Column:
    """Lower-case runs of alphabetic characters (vowel signs included) and numbers, order and repeats kept."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), "")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def index_terms(text: Column) -> Column:
    """Terms of the keyword index: words of fitting length that are no stop words."""
    return F.filter(words(text), lambda w: (F.octet_length(w) < LONGEST_TOKEN_BYTES) & ~w.isin(*STOP_WORDS))


def without_operators(query: Column) -> Column:
    """Query text with every operator character turned into a space."""
    return F.translate(query, OPERATOR_CHARS, " " * len(OPERATOR_CHARS))


def containment(a: Column, b: Column) -> Column:
    """Shared words over the smaller set of words; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    smaller = F.least(F.size(x), F.size(y))
    return F.when(smaller > 0, F.size(F.array_intersect(x, y)) / smaller).otherwise(F.lit(0.0))


def is_reordering(a: Column, b: Column) -> Column:
    """The same words with the same counts in another order."""
    return (a != b) & (F.array_sort(a) == F.array_sort(b))


def mentions(query_words: Column, name_words: Column) -> Column:
    """``name_words`` stand next to each other somewhere in ``query_words``."""
    pad = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    return (F.size(name_words) > 0) & F.contains(pad(query_words), pad(name_words))


def name_key(name: Column) -> Column:
    return F.lower(trimmed(name))


def is_hub(name: Column) -> Column:
    return name_key(name).isin(*HUB_NAMES)


def relation_name(raw: Column) -> Column:
    """Snake-case relation name of at most 64 bytes; may be empty."""
    kept = F.regexp_replace(F.lower(trimmed(raw)), r"[^a-z0-9_\s-]", "")
    snake = F.regexp_replace(F.regexp_replace(kept, r"[_\s-]+", "_"), r"^_", "")
    return F.regexp_replace(F.substring(snake, 1, 64), r"_+$", "")


def entity_label(raw: Column) -> Column:
    """Known entity type of a free label; anything else is a concept."""
    label = F.lower(trimmed(raw))
    known = None
    for text, kind in ENTITY_LABELS.items():
        known = F.when(label == text, kind) if known is None else known.when(label == text, kind)
    return known.otherwise("concept")


def snippet(text: Column) -> Column:
    return F.when(F.length(text) > SNIPPET_CHARS, F.concat(F.substring(text, 1, SNIPPET_CHARS), F.lit("…"))).otherwise(text)


def cut_bytes(text: Column, most: int = MAX_ERROR_BYTES) -> Column:
    """The longest prefix of whole characters within ``most`` UTF-8 bytes."""
    raw = text.cast("binary")
    head = F.make_valid_utf8(F.substring(raw, 1, most).cast("string"))
    # Only where the next byte goes on with a character was one cut; its bytes decode to one replacement mark.
    goes_on = F.hex(F.substring(raw, most + 1, 1)).between("80", "BF")
    return F.when(F.octet_length(text) <= most, text).when(goes_on, F.regexp_replace(head, "�$", "")).otherwise(head)


def duration(seconds: Column) -> Column:
    """``Ns``, ``Mm Ss`` or ``Hh Mm Ss``."""
    s = seconds.cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    return F.when(s < 60, text(s, "s")).when(s < 3600, text(m, "m ", r, "s")).otherwise(text(h, "h ", m, "m ", r, "s"))


def embed_text(content: Column, aliases: Column) -> Column:
    """Text that is embedded for an enriched fact."""
    return F.when(F.coalesce(aliases, F.lit("")) == "", content).otherwise(F.concat(content, F.lit(" Topics: "), aliases))


def clean_aliases(aliases: Column) -> Column:
    """Trimmed, lower-case, non-empty aliases joined by a comma and a space."""
    return F.array_join(F.filter(F.transform(aliases, lambda a: F.lower(trimmed(a))), lambda a: a != ""), ", ")


def rerank_prompt(content: Column) -> Column:
    """Subject frame and at most ``RERANK_CHARS`` characters for the relevance scorer."""
    return F.concat(F.lit("The user — "), F.substring(content, 1, RERANK_CHARS))


def has_control(text: Column) -> Column:
    return text.rlike(r"(?U)\p{Cntrl}")


def _starts(text: Column, prefix: str) -> Column:
    return F.lower(F.substring(text, 1, len(prefix))) == prefix.lower()


def _rest(text: Column, n: int) -> Column:
    return F.substring(text, F.lit(n + 1), F.length(text))


def _without_that(text: Column) -> Column:
    return F.when(_starts(text, "that "), _rest(text, 5)).otherwise(text)


def _first_of(text: Column, rules: list[tuple[str, Column]]) -> Column:
    """The value of the first rule whose prefix fits, else the text itself."""
    out = None
    for prefix, value in rules:
        out = F.when(_starts(text, prefix), value) if out is None else out.when(_starts(text, prefix), value)
    return out.otherwise(text)


def framing_removed(text: Column) -> Column:
    told = [(f"The user {v}", F.concat(F.lit("The user "), _without_that(_rest(text, len(v) + 9)))) for v in TOLD]
    return _first_of(text, [(p, _rest(text, len(p))) for p in ASKED] + told)


def opinion_removed(text: Column) -> Column:
    return _first_of(text, [(p, _without_that(_rest(text, len(p)))) for p in OPINIONS])


def third_person(text: Column) -> Column:
    return _first_of(text, [(p, F.concat(F.lit(f"The user {verb} "), _rest(text, len(p)))) for p, verb in FIRST_PERSON.items()])


def capitalised(text: Column) -> Column:
    return F.when(text.rlike("^[a-z]"), F.concat(F.upper(F.substring(text, 1, 1)), _rest(text, 1))).otherwise(text)


def ended(text: Column) -> Column:
    return F.when(text.rlike(r"[.!?]\z"), text).otherwise(F.concat(text, F.lit(".")))


def canonical_form(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the form in which a fact is saved; null for a text that is empty once trimmed.

    One projection a step: nested into one expression, every step would copy the one before
    several times.
    """
    rows = rows.withColumn(out, F.regexp_replace(F.col(column), r"^\s+|\s+\z", ""))
    for step in (framing_removed, opinion_removed, third_person, capitalised, ended):
        rows = rows.withColumn(out, step(F.col(out)))
    return rows.withColumn(out, F.when(F.regexp_replace(F.col(column), r"\s+", "") != "", F.col(out)))
