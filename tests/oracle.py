"""Runs a query and its SQL on the same tables and compares rows, whatever their order."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def difference(frame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both give the same rows."""
    names = sorted(frame.columns)
    want = con.execute(sql)
    theirs = [c[0] for c in want.description]
    if sorted(theirs) != names:
        return f"columns {names} against {sorted(theirs)}"
    place = [theirs.index(n) for n in names]
    a = Counter(tuple(map(plain, r)) for r in frame.select(names).collect())
    b = Counter(tuple(plain(r[k]) for k in place) for r in want.fetchall())
    if a == b:
        return ""
    return f"{names}: {sum(a.values())} against {sum(b.values())} rows; {list((a - b).items())[:2]} against {list((b - a).items())[:2]}"
