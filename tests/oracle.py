"""Comparison of a Spark query with DuckDB on the same files."""

import glob
import os

import duckdb
import pandas as pd


def compare(spark, sf_dir, query, sql):
    got = query(spark, sf_dir).toPandas()
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = c.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    text = lambda d: d[columns].astype(object).where(d[columns].notna(), None)
    a, b = (text(d).sort_values(columns, key=lambda s: s.map(str)).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b)
    for col in columns:
        for x, y in zip(a[col], b[col], strict=True):
            assert (x is None) == (y is None) and (x is None or x == y or (isinstance(x, float) and abs(x - y) <= 2e-6 * max(1, abs(x)))), (col, x, y)
