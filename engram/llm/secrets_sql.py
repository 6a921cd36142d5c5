"""The result of ``secrets.secret_digest`` in DuckDB's SQL, window by window."""

from __future__ import annotations

import math

from engram.llm.secrets import ALLOWED, ASSIGN_VALUE, ENTROPY_CLASSES, KINDS, SCALE

_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS)
_PATTERNS = {
    "assign": rf"""({_EITHER})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    # A run of hex digits between other marks is a run of letters and digits that are all hex.
    "entropy_hex": "[0-9A-Za-z]+",
    "entropy_base64": "[A-Za-z0-9+/_-]+",
}
_KEPT = {
    "assign": f"length(v) >= {ASSIGN_VALUE}",
    "access": "length(h) >= 16",
    "hex": "length(h) >= 32",
    "entropy_hex": "length(h) >= 20 AND regexp_full_match(h, '[0-9A-Fa-f]+')",
    "entropy_base64": "length(h) >= 20",
}


def _matches(kind: str) -> str:
    """Matches of one kind with their offsets: matches and the gaps between them, added up."""
    p, value = _PATTERNS[kind], "regexp_extract_all(t, '{}', 2)" if kind == "assign" else "NULL"
    return f"""{kind}_l AS (SELECT r, regexp_extract_all(t, '{p}') AS hs, string_split_regex(t, '{p}') AS gs, {value.format(p)} AS vs FROM d),
{kind}_i AS (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM {kind}_l WHERE len(hs) > 0),
{kind}_m AS (SELECT r, hs[i] AS h, {'vs[i]' if kind == 'assign' else 'NULL'} AS v,
  CAST(coalesce(list_sum(list_transform(hs[1:i - 1], lambda x: length(x))), 0) + list_sum(list_transform(gs[1:i], lambda x: length(x))) AS BIGINT) AS s FROM {kind}_i WHERE length(hs[i]) >= 9),
{kind}_k AS (SELECT r, h, s FROM {kind}_m WHERE {_KEPT[kind]})"""


def _hot(kind: str, window: int, bits: float) -> str:
    table = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(window + 1)]
    most = math.floor((math.log2(window) - bits) * window * SCALE)
    fine = " AND ".join(f"NOT regexp_matches(h, '{p}')" for p in ALLOWED)
    return f"""{kind}_w AS (SELECT r, s, p, substring(h, p + 1, {window}) AS w FROM (SELECT *, unnest(range(0, length(h) - {window - 1})) AS p FROM {kind}_k WHERE {fine})),
{kind}_c AS (SELECT r, s, p, c, count(*) AS n FROM (SELECT r, s, p, unnest(string_split(w, '')) AS c FROM {kind}_w) GROUP BY r, s, p, c),
{kind}_e AS (SELECT r, s, p FROM {kind}_c GROUP BY r, s, p HAVING sum(list_extract({table}, n + 1)) <= {most}),
{kind}_s AS (SELECT r, s + min(p) AS s, s + max(p) + {window} AS e FROM {kind}_e GROUP BY r, s)"""


_HOT = {k: (w, b) for k, _, _, w, b in ENTROPY_CLASSES}
_SPANS = " UNION ALL ".join(
    f"SELECT r, s, {'e' if k in _HOT else 's + length(h)'} AS e, {i} AS k, '{k}' AS kind FROM {k}_{'s' if k in _HOT else 'k'}" for i, k in enumerate(KINDS)
)
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{', '.join(_matches(k) for k in KINDS)},
{', '.join(_hot(k, *_HOT[k]) for k in _HOT)},
span AS ({_SPANS}),
told AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM span GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (r)
"""
