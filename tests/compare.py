"""Runs registered queries next to their oracle SQL and compares the rows.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf: str):
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false; SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return value
    if isinstance(value, list | tuple):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def kind(value) -> str:
    return {int: "int", float: "float", str: "str", bool: "bool"}.get(type(value), type(value).__name__)


def compare(spark, con, name: str, fn, sql: str | None, sf: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"rows={len(got)} spark={t1 - t0:.1f}s (no oracle)"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    note = f"rows={len(got)} spark={t1 - t0:.1f}s duckdb={time.time() - t1:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return False, f"first difference:\n   spark  {x}\n   oracle {y}"
    if got and want:
        first_a = {c: kind(v) for c, v in zip(df.columns, got[0])}
        first_b = {c: kind(v) for c, v in zip(names, want[0])}
        if any(first_a[c] != first_b[c] and "NoneType" not in (first_a[c], first_b[c]) for c in first_a):
            return False, f"types {first_a} vs {first_b}"
    return True, note


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from answerscope.session import local_session

    spark = local_session(8)
    con = oracle_connection(args.sf)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if args.names and not any(n in name for n in args.names):
            continue
        try:
            ok, note = compare(spark, con, name, fn, sqls.get(name), args.sf)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
