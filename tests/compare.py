"""Run a registered query and its SQL on the same tables and compare all rows."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return float(v) if not float(v).is_integer() else int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        r = round(v, 9)
        return int(r) if r.is_integer() else r
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    raise TypeError(f"queries return flat columns, not {type(v)}")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got, got_columns = rows_of(df.columns, df.collect())
    res = con.execute(sql)
    want, want_columns = rows_of([d[0] for d in res.description], res.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got != want:
        extra = list((got - want).items())[:3]
        missing = list((want - got).items())[:3]
        return (
            f"{sum(got.values())} rows vs {sum(want.values())}; columns {got_columns}\n"
            f"  only Spark: {extra}\n  only SQL: {missing}"
        )
    return None
