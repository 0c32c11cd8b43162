"""Runs a query and its SQL and compares their rows, whatever their order."""

import glob
import os

import duckdb


def connect(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def rows(frame):
    columns = sorted(frame.columns)
    out = frame[columns].copy()
    for c in columns:
        out[c] = out[c].astype(object).where(out[c].notna(), None).map(lambda v: v if v is None or isinstance(v, bool) else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) else str(v))
    return sorted(map(repr, out.itertuples(index=False, name=None)))


def compare(spark, query, sql, sf_dir):
    made, wanted = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(made.columns) == sorted(wanted.columns)
    assert len(made) == len(wanted) and len(made) > 0
    assert rows(made) == rows(wanted)
