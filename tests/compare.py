"""Rows of a query against rows of SQL, without regard to order."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connect(data=DATA):
    con = duckdb.connect()
    for f in sorted(os.listdir(data)):
        path = f"{data}/{f}" + ("/*.parquet" if os.path.isdir(f"{data}/{f}") else "")
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(df):
    """Sorted tuples of a pandas frame, columns by name, numbers rounded."""

    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return bool(x)
        if isinstance(x, (int, float)) or hasattr(x, "dtype") and getattr(x, "ndim", 1) == 0:
            return round(float(x), 9)
        return str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(one, r)) for r in df.itertuples(index=False, name=None)), key=str)


def same(spark, query, sql, data=DATA):
    got, want = query(spark, data).toPandas(), connect(data).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
