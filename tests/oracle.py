"""Compares a query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    """Asserts equal columns and rows, in any order; returns the number of rows."""
    names = sorted(df.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    a = sorted([plain(r[n]) for n in names] for r in df.collect())
    b = sorted([plain(r[i]) for i in at] for r in want.fetchall())
    assert a == b
    return len(a)
