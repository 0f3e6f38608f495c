"""Compares a query with its SQL on the same files."""

import glob
import os
from collections import Counter

import duckdb


def connect(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{d}/*.parquet"):
        path = f"{f}/*.parquet" if os.path.isdir(f) else f
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{path}')")
    return c


def text(x) -> str:
    if x is None or type(x).__name__ in ("NAType", "NaTType") or x != x:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int | float) or type(x).__name__ in ("float64", "int64", "int32", "Decimal"):
        return f"{float(x):.9g}"
    return str(x)


def rows(df) -> Counter:
    df = df[sorted(df.columns)].astype(object)
    return Counter(tuple(text(x) for x in r) for r in df.itertuples(index=False))
