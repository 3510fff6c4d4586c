"""Compare Spark results with DuckDB results, ignoring row and column order."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb

from gaugeboard.plans.registry import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


def differences(df, con, sql: str) -> list[str]:
    """Readable differences between a DataFrame and a SQL result; empty if equal."""
    got_names, got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_names, want = _sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    out = [] if len(got) == len(want) else [f"{len(got)} rows != {len(want)} rows"]
    kinds = lambda rows: [type(v).__name__ for v in rows[0]] if rows else []
    if not out and kinds(got) != kinds(want):
        out.append(f"kinds {kinds(got)} != {kinds(want)}")
    if got != want:
        in_got, in_want = set(got), set(want)
        extra, missing = [r for r in got if r not in in_want], [r for r in want if r not in in_got]
        out += [f"only spark: {r}" for r in extra[:3]] + [f"only sql:   {r}" for r in missing[:3]]
    return out
