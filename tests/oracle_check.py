"""Compares a Spark result with DuckDB's for the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{files}'")
    return c


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return repr(x)


def same(df, c: duckdb.DuckDBPyConnection, sql: str) -> None:
    names = sorted(df.columns)
    rows = c.sql(sql)
    assert sorted(rows.columns) == names
    order = ", ".join(f'"{n}"' for n in names)
    want = sorted(tuple(map(_cell, r)) for r in rows.project(order).fetchall())
    got = sorted(tuple(map(_cell, (r[n] for n in names))) for r in df.collect())
    assert len(got) == len(want)
    assert got == want
