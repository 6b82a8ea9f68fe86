"""Compares a query's rows with its oracle's, as the driver does: columns by name, values exact."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if hasattr(x, "item"):
        return cell(x.item())
    if isinstance(x, pd.Timestamp):
        return x.isoformat().removesuffix("T00:00:00")
    return int(x) if isinstance(x, int) and not isinstance(x, bool) else x if isinstance(x, (bool, str)) else str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(([cell(v) for v in r] for r in df.itertuples(index=False, name=None)), key=repr), list(df.columns)


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()
