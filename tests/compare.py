"""Run a registered query and its SQL counterpart and compare the rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def differences(df, con, sql: str, limit: int = 3) -> list[str]:
    """Empty when both results hold the same rows under the same names."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} <> {sorted(names)}"]
    expected = rows_of(names, result.fetchall())
    actual = rows_of(df.columns, df.collect())
    found = [f"missing {row}" for row in list((expected - actual))[:limit]]
    found += [f"extra {row}" for row in list((actual - expected))[:limit]]
    if found:
        found.append(f"{sum(actual.values())} rows, expected {sum(expected.values())}")
    return found
