"""Spark against DuckDB, query by query: `python -m tests.oracle [--sf 0.01] [name part ...]`."""

from __future__ import annotations

import argparse
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

from vicinage.plans.checks import all_checks
from vicinage.plans.views import NAMES, Tables
from vicinage.session import local_session


def plain(v):
    """One comparable form per value; doubles keep nine decimals."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 9) + 0.0)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    return con


def compare(spark, con, folder, check):
    started = time.time()
    df = check.run(Tables(spark, folder))
    mine = df.collect()
    spent = time.time() - started
    if check.sql is None:
        return True, f"{len(mine)} rows, no oracle", spent
    started = time.time()
    got = con.execute(check.sql)
    names = [d[0] for d in got.description]
    theirs = got.fetchall()
    other = time.time() - started
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}", spent
    if not mine:
        return False, "no rows", spent
    a, b = rows_of(df.columns, mine), rows_of(names, theirs)
    if a == b:
        return True, f"{len(mine)} rows (oracle {other:.1f}s)", spent
    only_a, only_b = a - b, b - a
    return False, (f"{len(mine)} vs {len(theirs)} rows; {sorted(df.columns)}\n      spark only {list(only_a)[:3]}"
                   f"\n      duckdb only {list(only_b)[:3]}"), spent


def main(argv: list[str]) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.001")
    ap.add_argument("parts", nargs="*")
    args = ap.parse_args(argv)
    folder = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(), connect(folder)
    failed = 0
    for name, c in all_checks().items():
        if args.parts and not any(name.startswith(p) for p in args.parts):
            continue
        try:
            ok, note, spent = compare(spark, con, folder, c)
        except Exception as exc:  # noqa: BLE001 - the report names it
            ok, note, spent = False, f"{type(exc).__name__}: {str(exc)[:600]}", 0.0
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {spent:.1f}s {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
