"""Compares a query with its SQL run by DuckDB on the same files."""

import glob
import math
import os
from collections import Counter

import duckdb


def connection(folder):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    return v


def compare(df, folder, sql):
    r = connection(folder).execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    place = [names.index(x) for x in df.columns]
    want = Counter(repr(tuple(plain(row[i]) for i in place)) for row in r.fetchall())
    got = Counter(repr(tuple(plain(v) for v in row)) for row in df.collect())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])
