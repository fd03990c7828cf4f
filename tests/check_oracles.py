"""Compare every query with its SQL on the given tables: python tests/check_oracles.py [folder] [names]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from coratia.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def sorted_rows(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, connection, folder: str, name: str) -> str:
    started = time.time()
    frame = queries()[name](spark, folder)
    found = sorted_rows(frame.columns, frame.collect())
    took = time.time() - started
    sql = oracle_sql().get(name)
    if sql is None:
        return f"rows only {len(found[1])} ({took:.1f}s)"
    started = time.time()
    result = connection.execute(sql)
    expected = sorted_rows([d[0] for d in result.description], result.fetchall())
    kinds = {d[0]: str(d[1]) for d in result.description}
    types = {f.name: f.dataType.simpleString() for f in frame.schema}
    note = f"{len(found[1])} rows ({took:.1f}s, sql {time.time() - started:.1f}s) {types} {kinds}"
    if found == expected:
        return "ok " + note
    wrong = [x for x in found[1] if x not in set(expected[1])][:3]
    missing = [x for x in expected[1] if x not in set(found[1])][:3]
    return f"DIFFERENT {note} {found[0]} vs {expected[0]}: {len(expected[1])} expected; extra {wrong}; missing {missing}"


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = build_session(
        "check", "local[8]", 8, {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    for name in names:
        print(name, compare(spark, connection, folder, name), flush=True)


if __name__ == "__main__":
    main()
