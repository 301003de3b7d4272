"""Rows of a Spark query against those of its DuckDB oracle, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from brindle.session import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, decimal.Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        return float(f"{value:.9g}") if abs(value) > 2**53 else value
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def differences(spark, name: str, query, oracle: str, sf_dir: str, con) -> str:
    """What differs; empty if nothing does."""
    mine = query(spark, sf_dir)
    theirs = con.execute(oracle)
    names = [d[0] for d in theirs.description]
    if sorted(mine.columns) != sorted(names):
        return f"{name}: columns {sorted(mine.columns)} and {sorted(names)}"
    a, b = rows(mine.columns, [tuple(r) for r in mine.collect()]), rows(names, theirs.fetchall())
    if len(a) != len(b):
        return f"{name}: {len(a)} rows and {len(b)}"
    apart = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y) and not all(p == q or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and math.isclose(p, q, rel_tol=1e-8)) for p, q in zip(x, y))]
    return f"{name}: {len(apart)} of {len(a)} rows differ, as {apart[0]}" if apart else ""
