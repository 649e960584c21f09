"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from crawlscope.catalog.fixtures import TABLES  # noqa: E402


def _value(v):
    if isinstance(v, decimal.Decimal):
        return f"decimal {v}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_value(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def compare(spark, sf_dir: str, con, fn, sql: str | None) -> tuple[bool, str]:
    started = time.time()
    result = fn(spark, sf_dir)
    got, columns = rows_of(result.columns, [tuple(r) for r in result.collect()])
    took = time.time() - started
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    relation = con.sql(sql)
    want, expected_columns = rows_of(relation.columns, relation.fetchall())
    if columns != expected_columns:
        return False, f"columns {columns} against {expected_columns}"
    if got != want:
        extra, absent = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return False, f"{len(got)} rows against {len(want)}\n   spark {extra[:2]}\n   sql   {absent[:2]}"
    return True, f"{len(got)} rows, {took:.1f}s"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from crawlscope.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    wanted = sys.argv[1:]
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, message = compare(spark, sf_dir, con, queries[name], oracles.get(name))
        except Exception as e:  # noqa: BLE001
            ok, message = False, f"{type(e).__name__} {str(e)[:700]}"
        if ok and "no SQL" not in message and message.startswith("0 rows"):
            message += "  EMPTY"
        print("ok  " if ok else "FAIL", name, message, flush=True)
