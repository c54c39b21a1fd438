"""Compare every query with its DuckDB text: ``python check_oracles.py [sf] [prefix …]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from veritab.catalog import ORACLES, QUERIES
from veritab.fixtures import BASE
from veritab.session import build


def session(cores: str = "8") -> SparkSession:
    return build(
        "veritab-check", f"local[{cores}]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false", spark__log__level="ERROR",
    )


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1e15 else str(v)
    return str(v)


def compare(rows_a, cols_a, rows_b, cols_b):
    if sorted(cols_a) != sorted(cols_b):
        return f"columns {sorted(cols_a)} vs {sorted(cols_b)}"
    ia, ib = [[c.index(n) for n in sorted(c)] for c in (cols_a, cols_b)]
    a = sorted(tuple(plain(r[i]) for i in ia) for r in rows_a)
    b = sorted(tuple(plain(r[i]) for i in ib) for r in rows_b)
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)} {extra}"
    if a != b:
        sa, sb = set(a), set(b)
        return f"values: spark {sorted(sa - sb)[:3]} duckdb {sorted(sb - sa)[:3]} ({len(sa - sb)} of {len(a)})"
    return None


def check(spark, con, sf_dir: str, name: str):
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    spent = time.time() - start
    if name not in ORACLES:
        return None, len(rows), spent
    cur = con.execute(ORACLES[name])
    return compare([tuple(r) for r in rows], df.columns, cur.fetchall(), [d[0] for d in cur.description]), len(rows), spent


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = str(Path("/root/testdata") / f"sf{sf}")
    spark, con = session(), database(sf_dir)
    bad = 0
    for name in sorted(QUERIES):
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        try:
            why, n, spent = check(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            why, n, spent = f"{type(e).__name__} {str(e)[:600]}", 0, 0.0
        bad += why is not None
        tag = "FAIL" if why else ("rows" if name not in ORACLES else "ok")
        print(f"{tag:5s} {name:32s} {n:8d} rows {spent:6.2f}s {why or ''}", flush=True)
    print("failed:", bad)
