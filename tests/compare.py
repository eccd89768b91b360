"""Runs registered queries in Spark and their SQL in DuckDB and compares the results.

Usage: python tests/compare.py [folder] [name prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    from talentlake.sources.domain import BASE_TABLES

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def fetch(con: duckdb.DuckDBPyConnection, sql: str) -> pa.Table:
    return con.execute(sql).to_arrow_table()


def kind(dtype: pa.DataType) -> str:
    t = pa.types
    if t.is_integer(dtype):
        return "int"
    if t.is_floating(dtype):
        return "float"
    if t.is_string(dtype) or t.is_large_string(dtype):
        return "string"
    if t.is_boolean(dtype):
        return "bool"
    if t.is_timestamp(dtype):
        return "timestamp"
    return str(dtype)


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return ("nan",)
        value = value + 0.0
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        value = value.replace(tzinfo=None)
    return (value is not None, value)


def rows(tbl: pa.Table) -> list[tuple]:
    names = sorted(tbl.column_names)
    columns = [[plain(v) for v in tbl.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=repr)


def compare(spark_table: pa.Table, duck_table: pa.Table) -> str | None:
    """None when equal, else what differs."""
    left, right = sorted(spark_table.column_names), sorted(duck_table.column_names)
    if left != right:
        return f"columns {left} vs {right}"
    for n in left:
        a, b = kind(spark_table.schema.field(n).type), kind(duck_table.schema.field(n).type)
        if a != b:
            return f"type of {n}: {a} vs {b}"
        if a.startswith(("list", "struct", "map", "decimal")):
            return f"column {n} has type {a}"
    if spark_table.num_rows != duck_table.num_rows:
        return f"rows {spark_table.num_rows} vs {duck_table.num_rows}"
    a, b = rows(spark_table), rows(duck_table)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        short = lambda r: [v[-1] for v in r]
        return f"{len(bad)} rows differ in {left}, first {short(bad[0][0])!r:.400} vs {short(bad[0][1])!r:.400}"
    return None


def main(argv: list[str]) -> int:
    from talentlake.catalog import load
    from talentlake.session import local_session

    folder = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    prefixes = tuple(a for a in argv if not a.startswith("/"))
    spark = local_session()
    con = duck(folder)
    failed, total = [], 0
    for name, q in load().items():
        if prefixes and not name.startswith(prefixes):
            continue
        total += 1
        started = time.time()
        try:
            got = q.run(spark, folder).toArrow()
            spent = time.time() - started
            started = time.time()
            if q.sql is None:
                problem = None
                note = "rows only"
            else:
                want = fetch(con, q.sql)
                problem = compare(got, want)
                note = f"sql {time.time() - started:.1f}s"
            print(f"{'ok  ' if not problem else 'DIFF'} {name} rows={got.num_rows} {spent:.1f}s {note}", flush=True)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
            print(f"FAIL {name}", flush=True)
        if problem:
            failed.append(name)
            print("     ", problem, flush=True)
    print(f"{total - len(failed)}/{total} ok; failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
