"""Runs registered queries in Spark and their oracle in DuckDB and compares whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import time
from pathlib import Path

import duckdb

# joins without an equality, and Python called row by row
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def oracle_rows(sql: str, folder: str):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    return _rows([d[0] for d in cur.description], cur.fetchall())


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def check(spark, name: str, job, sql: str | None, folder: str) -> tuple[bool, str]:
    t = time.time()
    df = job(spark, folder)
    text = df._jdf.queryExecution().executedPlan().toString()
    for word in UNWANTED:
        if word in text:
            return False, f"{name}: {word} in its plan"
    cols, rows = spark_rows(df)
    took = time.time() - t
    if sql is None:
        return True, f"{name}: {len(rows)} rows, no oracle, {took:.1f}s"
    t = time.time()
    ocols, orows = oracle_rows(sql, folder)
    head = f"{name}: spark {len(rows)} oracle {len(orows)} rows, {took:.1f}s / {time.time() - t:.1f}s"
    if cols != ocols:
        return False, f"{head}\n  columns {cols} <> {ocols}"
    if rows != orows:
        a, b = set(map(repr, rows)), set(map(repr, orows))
        return False, f"{head}\n  only spark {sorted(a - b)[:4]}\n  only oracle {sorted(b - a)[:4]}"
    return True, head
