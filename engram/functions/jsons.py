"""JSON handling with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Field order of the hashed body of an audit event.
AUDIT_FIELDS = (
    "event_id", "timestamp", "user_id", "device_id", "event_type", "resource_type", "resource_id", "boundary", "actor_kind", "actor_name", "result", "details_json",
)


def metadata(document: Column, path: str) -> Column:
    return F.get_json_object(document, f"$.{path}")


def with_key(document: Column, name: str, value: Column) -> Column:
    """``document`` with a top-level key set to the JSON text ``value``; no object counts as ``{}``."""
    # Members are kept as the JSON text they had, so numbers and nesting come back unchanged.
    members = F.coalesce(F.from_json(document, "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    others = F.map_filter(members, lambda k, v: k != name)
    text = F.transform(F.map_entries(others), lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))), F.lit("\x1f"), F.to_json(e["value"])))
    # {"k":"name"} gives the escaped name.
    member = F.transform(text, lambda t: F.concat(F.regexp_extract(t, r'^\{"k":(.*)\}\x1f', 1), F.lit(":"), F.regexp_extract(t, "(?s)\x1f(.*)", 1)))
    added = F.concat(F.lit(f'"{name}":'), value)
    return F.concat(F.lit("{"), F.array_join(F.array_sort(F.array_append(member, added)), ","), F.lit("}"))


def quoted(text: Column) -> Column:
    """``text`` as a JSON string with its quotes."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)


def audit_body(fields: dict[str, Column] | None = None) -> Column:
    """The canonical JSON of an audit event: fields in their fixed order, nulls written out."""
    column = lambda n: (fields or {}).get(n, F.col(n)).cast("string").alias(n)
    return F.to_json(F.struct(*[column(n) for n in AUDIT_FIELDS]), {"ignoreNullFields": "false"})
