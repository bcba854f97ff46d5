"""Compares a query with its SQL in DuckDB, as sets of rows."""

import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def same(df, sql, sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    found = con.sql(sql)
    names = sorted(df.columns)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    mine = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    assert mine == theirs
