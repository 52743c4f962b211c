"""Run a query in Spark and its statement in DuckDB and compare the rows."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _norm(v):
    if isinstance(v, (bool, str)) or v is None:
        return v
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        return None if math.isnan(f) else round(f, 6)
    if isinstance(v, (datetime, date)):
        return str(v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a short description of the difference."""
    df = query(spark, sf_dir)
    cols, got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    ecols, want = rows_of(rel.columns, rel.fetchall())
    if cols != ecols:
        return f"columns {cols} != {ecols}"
    if len(got) != len(want):
        only = sorted(set(got) - set(want), key=repr)[:3], sorted(set(want) - set(got), key=repr)[:3]
        return f"rows {len(got)} != {len(want)}: spark only {only[0]}, duckdb only {only[1]}"
    for a, b in zip(got, want):
        if a != b:
            return f"spark {a} != duckdb {b}"
    return None if got else "no rows"
