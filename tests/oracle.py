"""Comparing a query with its SQL on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def compare(df, con, sql):
    """Assert that both have the same columns and the same rows, in any order."""
    theirs = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(theirs.columns)
    mine = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [theirs.columns.index(c) for c in columns]
    want = sorted((tuple(_plain(r[k]) for k in at) for r in theirs.fetchall()), key=repr)
    assert mine == want
