"""Runs a query's SQL in DuckDB and compares rows without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connect(tables: dict | None = None) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(DATA.glob("*.parquet")):
        if tables is None or p.stem not in tables:
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, frame in (tables or {}).items():
        con.register(name, frame)
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value) if not isinstance(value, (int, str, bool)) else value


def same_rows(df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    assert got == expected
    return len(got)
