"""Rows of a Spark query and of its SQL in DuckDB, made comparable."""

import datetime
import decimal
import math
import os

import duckdb
import numpy as np


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, float | np.floating):
        return float(f"{float(v):.9g}")
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v) if isinstance(v, datetime.date) else v


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert mine == theirs
