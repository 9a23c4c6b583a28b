"""Run queries on Spark and DuckDB over one folder and compare the rows.

Usage: python -m checks.compare FOLDER [QUERY …]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.orders import out_of_order

TABLES = ("events",)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value: object) -> tuple[str, str]:
    if value is None:
        return ("", "NULL")
    if isinstance(value, float):
        return ("float", "NaN" if math.isnan(value) else repr(value))
    return (type(value).__name__, str(value))


def _rows(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, folder: str, query, sql: str, name: str = "") -> str:
    """Empty when column names, types of values, and values agree, and the report ``name`` is in its order, else what differs."""
    result = query(spark, folder)
    collected = result.collect()
    if problem := out_of_order(name, result.columns, collected):
        return problem
    ours = _rows(result.columns, collected)
    answer = con.execute(sql)
    names = [column[0] for column in answer.description]
    theirs = _rows(names, answer.fetchall())
    if sorted(result.columns) != sorted(names):
        return f"columns {sorted(result.columns)} against {sorted(names)}"
    if ours != theirs:
        only_ours = [row for row in ours if row not in set(theirs)][:2]
        only_theirs = [row for row in theirs if row not in set(ours)][:2]
        return f"{len(ours)} against {len(theirs)} rows; first differences {only_ours} against {only_theirs}"
    return "" if ours else "no rows"


if __name__ == "__main__":
    from checks.oracle_sql import statements
    from checks.catalog import catalog
    from ranlens.session import build_session

    folder, chosen = sys.argv[1], sys.argv[2:]
    session = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    database, sqls = connect(folder), statements()
    failed = 0
    for name, query in catalog().items():
        if chosen and name not in chosen:
            continue
        started = time.time()
        problem = differences(session, database, folder, query, sqls[name], name)
        failed += bool(problem)
        print(f"{name:28s} {time.time() - started:6.2f}s  {problem or 'ok'}", flush=True)
    print(f"{failed} of {len(catalog())} differ")
