"""Compares a query with its SQL in DuckDB, over the driver's tables."""

import glob
import os
from collections import Counter

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def shown(value):
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def rows(found):
    return Counter(tuple(map(shown, r)) for r in found)


def compare(con, frame, sql):
    columns = sorted(frame.columns)
    other = con.sql(sql)
    assert sorted(other.columns) == columns
    want = other.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert rows(frame.select(*columns).collect()) == rows(want)
