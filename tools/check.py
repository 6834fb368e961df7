"""Runs queries on both engines and reports differences.

    python tools/check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberline.catalog import CHECKS, QUERIES  # noqa: E402
from emberline.session import session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def fetch_spark(df):
    names = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    return names, rows


def fetch_duck(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]


def key(row):
    return tuple((v is None, str(v)) for v in row)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = session(
        "check",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = 0
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            names, rows = fetch_spark(run(spark, sf))
        except Exception as e:  # report and go on
            bad += 1
            print(f"FAIL {name}: spark: {str(e)[:600]}", flush=True)
            continue
        took = time.time() - start
        if name not in CHECKS:
            print(f"rows {name}: {len(rows)} rows {took:.1f}s", rows[:3] if len(rows) < 30 else "", flush=True)
            continue
        start = time.time()
        try:
            dnames, drows = fetch_duck(con, CHECKS[name])
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: duckdb: {str(e)[:600]}", flush=True)
            continue
        dtook = time.time() - start
        rows.sort(key=key)
        drows.sort(key=key)
        ok = names == dnames and rows == drows
        kinds = [
            (n, type(a), type(b))
            for n, a, b in zip(names, rows[0] if rows else (), drows[0] if drows else ())
            if a is not None and b is not None and type(a) is not type(b)
        ]
        print(f"{'ok  ' if ok and not kinds else 'DIFF'} {name}: {len(rows)} rows, spark {took:.1f}s duckdb {dtook:.1f}s {kinds or ''}", flush=True)
        if not ok or kinds:
            bad += 1
            print("   ", names, dnames, len(rows), len(drows))
            here, there = set(rows), set(drows)
            gone = [r for r in rows if r not in there][:3]
            new = [r for r in drows if r not in here][:3]
            print("    only spark ", gone)
            print("    only duckdb", new, flush=True)
    print("differences:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
