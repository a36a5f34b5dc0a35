"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, repr(v + 0.0))
    return (3, str(v))


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, fn, sql: str) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    problem = ""
    if sorted(df.columns) != sorted(want_cols):
        problem = f"columns {sorted(set(df.columns) ^ set(want_cols))}"
    elif len(a) != len(b):
        problem = f"rows {len(a)} against {len(b)}"
    elif a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        problem = f"{len(bad)} rows differ, first {bad[0]}"
    return {"rows": len(got), "spark": t1 - t0, "duckdb": t2 - t1, "problem": problem}


if __name__ == "__main__":
    import __spark_entry__ as entry
    from runledger import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        if name not in entry.oracle_sql():
            print(name, "no sql", fn(spark, sf).count())
            continue
        r = compare(spark, con, sf, fn, entry.oracle_sql()[name])
        print(f"{'ok ' if not r['problem'] else 'BAD'} {name:28} rows {r['rows']:7} spark {r['spark']:.2f} duckdb {r['duckdb']:.2f} {r['problem'][:600]}", flush=True)
