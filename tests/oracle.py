"""Compares a query with its DuckDB SQL, as multisets of rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb


def plain(value):
    """A comparable form of a cell from either engine."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, bytearray | bytes):
        return bytes(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list | tuple):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def duck(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{base}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def compare(df, sql: str, base: str) -> tuple[int, Counter, Counter]:
    """Rows of df, then the rows only in df and only in the SQL's result."""
    rows = df.collect()
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    ours = Counter(tuple(plain(r[i]) for i in order) for r in rows)
    cur = duck(base).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    order = sorted(range(len(names)), key=lambda i: names[i])
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    return len(rows), ours - theirs, theirs - ours
