"""Run queries next to their SQL in DuckDB and compare the rows.

    python tests/check_oracles.py FOLDER [NAME ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> str:
    start = time.time()
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if sql is None:
        return f"rows {len(mine)} {spent:.1f}s"
    start = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    took = f"{spent:.1f}s, sql {time.time() - start:.1f}s"
    if sorted(df.columns) != sorted(names):
        return f"FAIL columns {df.columns} {names} {took}"
    if mine != theirs:
        only = [r for r in mine if r not in set(theirs)][:2], [r for r in theirs if r not in set(mine)][:2]
        return f"FAIL {len(mine)} {len(theirs)} {took} {str(only)[:600]}"
    return f"ok {len(mine)} {took}"


def main() -> None:
    import __spark_entry__ as entry
    from shelfmark.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(folder)
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            print(name, compare(spark, con, folder, name, query, sql.get(name)), flush=True)
        except Exception as error:  # noqa: BLE001 - report and go on
            print(name, "ERROR", type(error).__name__, str(error)[:500].replace("\n", " "), flush=True)


if __name__ == "__main__":
    main()
