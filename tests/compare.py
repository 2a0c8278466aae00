"""Compare every named query with its SQL on DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        x = float(value)
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    mine = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(set(df.columns) ^ set(names))}"
    a, b = rows_of(df.columns, mine), rows_of(names, theirs)
    if a == b:
        return None
    left, right = set(map(repr, a)), set(map(repr, b))
    extra = sorted(left - right)[:2]
    missing = sorted(right - left)[:2]
    return f"{len(a)} vs {len(b)} rows\n  cols {sorted(names)}\n  spark {extra}\n  duck  {missing}"
