"""Compare a query with its SQL: columns by name, rows without order, values exactly."""

import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        name, path = f.split(".")[0], f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def frame(df):
    df = df[sorted(df.columns)]
    df = df.apply(lambda c: c.map(lambda v: repr(round(v, 9)) if isinstance(v, float) else "" if v is None or v is pd.NaT else str(v)))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differs(got, wanted):
    if sorted(got.columns) != sorted(wanted.columns):
        return f"columns {sorted(got.columns)} and {sorted(wanted.columns)}"
    a, b = frame(got), frame(wanted)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = (a != b).any(axis=1)
    return f"{bad.sum()} rows differ, such as {a[bad].iloc[0].to_dict()} and {b[bad].iloc[0].to_dict()}" if bad.any() else ""
