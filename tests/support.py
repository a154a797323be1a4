"""Runs a query and its SQL on the same tables and compares their rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_DATA", "/root/testdata")


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple("" if v is None or v is pd.NA or v != v else str(v) for v in r) for r in df.itertuples(index=False)))


def compare(spark, f, sql: str, sf_dir: str) -> None:
    ours, theirs = f(spark, sf_dir).toPandas(), tables(sf_dir).execute(sql).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    for c in ours.columns:
        if str(ours[c].dtype) in ("float64", "Float64") or str(theirs[c].dtype) in ("float64", "Float64"):
            ours[c], theirs[c] = ours[c].astype("Float64"), theirs[c].astype("Float64")
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b), (len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not wrong, (len(wrong), wrong[:3])
