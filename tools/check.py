"""Compare scenario queries with their SQL checks: python tools/check.py SF_DIR [name-part ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import configure, staging  # noqa: E402
from scenarios import all_oracles, all_queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def cell(v):
    if isinstance(v, float):
        return repr(v)
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple((type(r[i]).__name__, cell(r[i])) for i in order) for r in data), sorted(columns)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    started = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - started
    left, cols = rows_of(df.columns, got)
    if sql is None:
        return "rows-only", len(got), took, ""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    right, want_cols = rows_of(names, res.fetchall())
    if cols != want_cols:
        return "COLUMNS", len(got), took, f"{cols} vs {want_cols}"
    if left == right:
        return "ok", len(got), took, ""
    extra = [r for r in left if r not in set(right)][:2]
    lack = [r for r in right if r not in set(left)][:2]
    return "DIFF", len(got), took, f"spark {len(left)} oracle {len(right)}\n   only spark {extra}\n   only oracle {lack}"


def main() -> int:
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark = configure(
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g"), 8
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), all_oracles(), 0
    for name, fn in all_queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            with staging(spark):
                state, n, took, note = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            state, n, took, note = "ERROR", 0, 0.0, str(e)[:1500]
        bad += state not in ("ok", "rows-only")
        print(f"{state:9} {name:32} rows={n:<8} {took:6.2f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
