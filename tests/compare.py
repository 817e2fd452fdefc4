"""Rows of a Spark query and of its SQL, in comparable form."""

import datetime
import glob
import math
import os

import duckdb
import pandas as pd


def connect(folder):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if hasattr(v, "tolist") and not isinstance(v, pd.Timestamp):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}"
    if isinstance(v, (datetime.datetime, pd.Timestamp)):
        return v.strftime("%F %T").removesuffix(" 00:00:00")  # dates come as either
    return str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return sorted(tuple(map(norm, r)) for r in pdf[cols].astype(object).itertuples(index=False))
