"""Compare every registered query with its SQL: python tests/check_oracles.py [folder] [names...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_points  # noqa: E402
from tidewell.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, connection, name: str, folder: str) -> tuple[bool, str]:
    started = time.time()
    frame = entry_points.queries()[name](spark, folder)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    took = time.time() - started
    started = time.time()
    relation = connection.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in relation.description]
    want = rows_of(columns, relation.fetchall())
    oracle_took = time.time() - started
    text = f"{len(got)} rows, {took:.2f}s, sql {oracle_took:.2f}s"
    if sorted(frame.columns) != sorted(columns):
        return False, f"{text}; columns {sorted(frame.columns)} != {sorted(columns)}"
    if got != want:
        wrong = next((p for p in zip(got, want) if p[0] != p[1]), (len(got), len(want)))
        return False, f"{text}; {len(want)} wanted; first difference {str(wrong)[:600]}"
    return True, text


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(entry_points.oracle_sql())
    spark = build_session(
        "check",
        "local[8]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=8,
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    failed = 0
    for name in names:
        try:
            ok, text = compare(spark, connection, name, folder)
        except Exception as error:  # report and go on to the next query
            ok, text = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, text, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
