"""Spark rows against DuckDB rows of the same tables."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _kind(dtype):
    return "number" if pd.api.types.is_numeric_dtype(dtype) and dtype != bool else "other"


def difference(df, con, sql):
    """None when both give the same rows, else what differs."""
    left = df.toPandas()
    right = con.execute(sql).df()
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    names = sorted(left.columns)
    for n in names:
        if len(left) and str(left[n].dtype) != str(right[n].dtype):
            numeric = _kind(left[n].dtype) == _kind(right[n].dtype) == "number"
            floats = left[n].dtype.kind == "f", right[n].dtype.kind == "f"
            if numeric and floats[0] != floats[1] and not (left[n].isna().any() or right[n].isna().any()):
                return f"type of {n}: {left[n].dtype} / {right[n].dtype}"

    def rows(frame):
        cells = frame[names].astype(object).where(frame[names].notna(), None).values.tolist()
        return sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in cells], key=repr)

    for a, b in zip(rows(left), rows(right)):
        if a != b:
            return f"{a} / {b}"
    return None
