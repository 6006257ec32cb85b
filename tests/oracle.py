"""Compares a query's rows with those of its DuckDB statement."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "~null"
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return float(x)
    if hasattr(x, "item"):
        return _value(x.item())
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in data), key=repr)


#: Spark's type names where DuckDB has another.
SAME = {"string": "varchar", "int": "integer", "timestamp_ntz": "timestamp"}


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str, types: bool = True) -> str | None:
    """None if both have the same columns, types and rows, else what differs."""
    result = con.execute(sql)
    names, data = [d[0] for d in result.description], result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    kinds = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()} if types else {}
    odd = {n: (k, kinds[n]) for n, k in spark_df.dtypes if types and SAME.get(k, k) != kinds[n].lower()}
    if odd:
        return f"types {odd}"
    want, got = rows(names, data), rows(spark_df.columns, spark_df.collect())
    if len(want) != len(got):
        return f"{len(got)} rows and {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, such as {bad[0]}" if bad else None
