"""Runs registered queries against their DuckDB oracle.

    python tests/oracle_check.py [--sf DIR] [name-prefix …]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = {"HUGEINT": "int", "BIGINT": "int", "INTEGER": "int", "SMALLINT": "int", "TINYINT": "int",
         "UBIGINT": "int", "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "str", "BOOLEAN": "bool",
         "bigint": "int", "int": "int", "double": "float", "float": "float", "string": "str",
         "boolean": "bool"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def order(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in result.description}
    ours = dict(df.dtypes)
    if sorted(theirs) != sorted(ours):
        return f"columns {sorted(ours)} vs {sorted(theirs)}"
    names = sorted(ours)
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    for n in names:
        a, b = KINDS.get(ours[n], ours[n]), KINDS.get(types[n], types[n])
        if a != b:
            return f"type of {n}: {ours[n]} vs {types[n]}"
    position = [list(theirs).index(n) for n in names]
    right = sorted((tuple(normal(r[i]) for i in position) for r in con.execute(sql).fetchall()),
                   key=order)
    left = sorted((tuple(normal(v) for v in r) for r in
                   [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]), key=order)
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}; only ours {list(set(left) - set(right))[:2]}; only theirs {list(set(right) - set(left))[:2]}"
    for a, b in zip(left, right):
        if a != b:
            diff = {n: (x, y) for n, x, y in zip(names, a, b) if x != y}
            return f"values {diff} in {dict(zip(names, a))}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()

    import __spark_entry__ as entry
    from catchment.session import build_session
    spark = build_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                rows = "oracle"
            else:
                rows, problem = f"{df.count()} rows", None
        except Exception as e:  # report and go on with the next query
            rows, problem = "error", f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {rows} {time.time() - start:.1f}s {problem or ''}",
              flush=True)
    print(f"{bad} failed")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
