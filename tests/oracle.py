"""Compares a Spark result with DuckDB's, columns by name, rows in any order."""

import math
import os

import duckdb
import pandas as pd


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    return round(value, 6) + 0.0 if isinstance(value, float) and math.isfinite(value) else value


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(float(v) if isinstance(v := plain(x), (int, float)) and not isinstance(v, bool) else v for x in row) for row in frame.itertuples(index=False)), key=repr)


def assert_same(found, wanted):
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)
