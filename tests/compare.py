"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/compare.py [sf_dir] [query ...]
"""

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return float(value) if isinstance(value, Decimal) else value


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return _rows(df.collect(), df.columns), sorted(df.columns)


def oracle_rows(sf_dir, sql):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = con.sql(sql)
    return _rows(found.fetchall(), found.columns), sorted(found.columns)


def difference(df, sf_dir, sql):
    """None when the rows agree, else a short description."""
    got, got_names = spark_rows(df)
    want, want_names = oracle_rows(sf_dir, sql)
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{got_names}\n   spark {a}\n   sql   {b}"
    return None


def main() -> int:
    sys.path.insert(0, ROOT)
    from bench import session

    from palisade.plans import ORACLE, QUERIES

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = session("compare")
    bad = 0
    for name in args or QUERIES:
        begun = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            text = difference(df, sf_dir, ORACLE[name]) if name in ORACLE else f"rows only: {df.count()}"
            state = "ok" if text is None else ("--" if name not in ORACLE else "BAD")
        except Exception as error:  # noqa: BLE001
            state, text = "ERR", str(error)[:1500]
        bad += state in ("BAD", "ERR")
        print(f"{state:4} {name:28} {time.time() - begun:6.1f}s {text or ''}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main())
