"""Compare every registered query with its SQL statement: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 6) + 0.0
    if isinstance(value, dict):
        return str(sorted((k, normal(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return str([normal(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(normal(r[i]) for i in order) for r in rows], key=str)


def compare(spark, con, name, fn, sql, sf_dir):
    began = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - began
    if sql is None:
        return "rows-only", len(rows), took, ""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", len(rows), took, f"{sorted(df.columns)} vs {sorted(names)}"
    mine, theirs = rows_of(df.columns, rows), rows_of(names, expected)
    if mine == theirs:
        return "ok", len(rows), took, ""
    mine_set, theirs_set = set(mine), set(theirs)
    only_mine = [r for r in mine if r not in theirs_set][:2]
    only_theirs = [r for r in theirs if r not in mine_set][:2]
    return "DIFF", len(rows), took, f"{len(rows)} vs {len(expected)}\n   spark {only_mine}\n   sql   {only_theirs}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    oracles, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        try:
            status, n, took, note = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            status, n, took, note = "ERROR", -1, 0.0, str(exc)[:700]
        bad += status not in ("ok", "rows-only")
        print(f"{status:9s} {name:32s} rows={n:<8d} {took:6.2f}s {note}", flush=True)
    print(f"failures: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
