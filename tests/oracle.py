"""Runs a query and its oracle SQL over the same tables and compares the rows."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def tables(base):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in glob.glob(f"{base}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, (float, np.floating)) and v != v:
        return None
    if isinstance(v, (list, np.ndarray)):
        return str([plain(x) for x in v])
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.9g}"
    if hasattr(v, "isoformat"):
        t = pd.Timestamp(v)
        return str(t.tz_localize(None) if t.tzinfo is None else t.tz_convert("UTC").tz_localize(None))
    return str(v)


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


def check(name, spark, base):
    import __spark_entry__ as e

    got, want = e.queries()[name](spark, base).toPandas(), tables(base).sql(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
