"""Run registered queries and their check SQL side by side.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("events", "pages")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else round(float(value), 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duckdb_rows(con, sql):
    cursor = con.execute(sql)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())


def main() -> int:
    from footfall.plans import registry
    from footfall.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(registry.QUERIES)
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name in wanted:
        began = time.time()
        try:
            got = spark_rows(registry.QUERIES[name](spark, folder))
            took = time.time() - began
            want = duckdb_rows(con, registry.ORACLE[name])
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"{name}: ERROR {str(error)[:700]}", flush=True)
            continue
        same = got == want
        bad += not same
        print(f"{name}: {'ok' if same else 'DIFFERS'} rows={len(got[1])}/{len(want[1])} {took:.2f}s", flush=True)
        if not same:
            print("   columns", got[0] if got[0] == want[0] else (got[0], want[0]))
            only = [r for r in got[1] if r not in set(want[1])][:2], [r for r in want[1] if r not in set(got[1])][:2]
            print("   spark only", only[0], "\n   sql only  ", only[1])
    return bad


if __name__ == "__main__":
    sys.exit(main())
