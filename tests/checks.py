"""Comparison of queries with their oracles."""

import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in os.listdir(folder):
        con.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{p}')")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return None if v is None or v is pd.NaT else v


def rows(df):
    return sorted(map(repr, (tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))))
