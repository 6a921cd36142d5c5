"""Runs a registered query and its oracle SQL on one folder of tables and compares them."""

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (Decimal, float)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, int):
        return round(float(v), 5)
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(query, sql, spark, con, sf_dir):
    """None if both agree, else what differs."""
    df = query(spark, sf_dir)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns {names} and {want_names}"
    if got == want:
        return None
    here, there = set(map(repr, got)), set(map(repr, want))
    return f"{len(got)} and {len(want)} rows; only Spark: {sorted(here - there)[:2]}; only SQL: {sorted(there - here)[:2]}"
