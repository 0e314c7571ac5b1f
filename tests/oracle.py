"""Compare a Spark query with its DuckDB oracle, the way the driver does:
column names, row count, and an order-insensitive hash of the values."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

from tessera.sources.tables import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v  # exact: both sides round explicitly in the query / SQL
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark_pdf, duck_pdf):
    c1, r1 = rows_of(spark_pdf)
    c2, r2 = rows_of(duck_pdf)
    problems = []
    if c1 != c2:
        problems.append(f"columns differ: {c1} vs {c2}")
        return problems
    if len(r1) != len(r2):
        problems.append(f"row count {len(r1)} vs {len(r2)}")
        return problems
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ, e.g. {bad[0][0]} vs {bad[0][1]}")
    return problems


_DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
               "TIMESTAMP": "timestamp", "DATE": "date", "FLOAT": "float", "SMALLINT": "smallint"}


def canon_duck(t) -> str:
    t = str(t).upper()
    return "DECIMAL" if t.startswith("DECIMAL") else _DUCK_TYPES.get(t, t)
