"""Run registered queries against their SQL: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v) + 0.0:.9g}"  # adding zero makes -0 print as 0
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return "NO SQL", took, 0.0
    start = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    took_sql = time.time() - start
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}", took, took_sql
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return f"ok {len(a)}", took, took_sql
    in_a, in_b = set(a), set(b)
    extra = [r for r in a if r not in in_b][:2]
    missing = [r for r in b if r not in in_a][:2]
    return f"DIFF {len(a)} vs {len(b)}\n   spark {extra}\n   duck  {missing}", took, took_sql


def main(argv):
    from leakscope.plans.registry import ORACLES, QUERIES, load
    from leakscope.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    load()
    spark = local_session(cores="8", **{"spark.ui.showConsoleProgress": "false"})
    con = duck(sf_dir)
    bad = 0
    for name in argv[1:] or list(QUERIES):
        try:
            out, t, ts = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            out, t, ts = f"ERROR {type(e).__name__} {str(e)[:600]}", 0, 0
        bad += not out.startswith(("ok", "rows"))
        print(f"{name:28s} {t:6.2f}s sql {ts:6.2f}s  {out}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
