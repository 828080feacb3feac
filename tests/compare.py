"""Rows of a query against rows of its SQL."""

import glob
import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return repr(round(float(v), 4))
    return str(v)


def same_rows(df, con, sql):
    cols = sorted(df.columns)
    got = sorted("|".join(norm(x) for x in r) for r in df.select(*cols).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted("|".join(norm(r[i]) for i in at) for r in cur.fetchall())
    assert got == want
