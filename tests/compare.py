"""Rows of a query against the rows of its SQL."""

import os

import duckdb
import pandas as pd


def connect(folder):
    c = duckdb.connect()
    for t in os.listdir(folder):
        path = os.path.join(folder, t)
        files = os.path.join(path, "*.parquet") if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{files}')")
    return c


def plain(df):
    """Values as text, rows and columns in order; floats to nine digits."""

    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "uint", "float")):
            return f"{float(v):.9g}"
        return str(v)

    df = df[sorted(df.columns)].map(one)
    return df.sort_values(list(df.columns)).reset_index(drop=True)
