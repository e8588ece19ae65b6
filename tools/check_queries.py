"""Run registered queries beside their comparison SQL.

    python tools/check_queries.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from datetime import date, datetime
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from shelfspark.session import local_session  # noqa: E402
from shelfspark.workload import load  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return repr(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql) -> tuple[bool, str]:
    started = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    seconds = time.time() - started
    if sql is None:
        return True, f"rows-only {len(rows)} rows {seconds:.2f}s"
    cursor = con.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    got_columns, got = normal(df.columns, [tuple(r) for r in rows])
    want_columns, want = normal(expected_columns, expected)
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}"
    if got == want:
        return True, f"{len(rows)} rows {seconds:.2f}s"
    missing = [r for r in want if r not in set(got)][:3]
    extra = [r for r in got if r not in set(want)][:3]
    return False, f"rows {len(got)} vs {len(want)}\n   {got_columns}\n   want {missing}\n   got  {extra}"


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    queries, oracles = load()
    names = [n for n in queries if not args or n in args or any(n.startswith(a) for a in args)]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, sf_dir, name, queries[name], oracles.get(name))
        except Exception:
            ok, note = False, traceback.format_exc(limit=3)[-1500:]
        bad += not ok
        print(("ok   " if ok else "FAIL ") + f"{name}: {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
