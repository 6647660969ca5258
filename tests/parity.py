"""Compares a query with its SQL counterpart in DuckDB, row by row."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 2")
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (datetime.datetime, pd.Timestamp)):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "item"):
        v = v.item()
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(names: list[str], found: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(df, con: duckdb.DuckDBPyConnection, text: str) -> str:
    """Empty if both agree, else what differs first."""
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} and {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{a} and {b}"
    return ""
