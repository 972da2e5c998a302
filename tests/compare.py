"""Run a query on Spark and its SQL on DuckDB and compare rows exactly."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

from __spark_entry__ import oracle_sql, queries

TESTDATA = "/root/testdata"


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(repr(row[i]) for i in order) for row in rows)


def differences(spark, sf_dir: str, name: str) -> str | None:
    df = queries()[name](spark, sf_dir)
    result = database(sf_dir).execute(oracle_sql()[name])
    expected_names = [d[0] for d in result.description]
    if sorted(df.columns) != sorted(expected_names):
        return f"columns {sorted(df.columns)} != {sorted(expected_names)}"
    got = _rows(df.columns, df.collect())
    expected = _rows(expected_names, result.fetchall())
    if got == expected:
        return None
    surplus, missing = got - expected, expected - got
    return (
        f"{got.total()} rows, expected {expected.total()}; "
        f"surplus {list(surplus)[:2]}; missing {list(missing)[:2]}"
    )
