"""Compares a query's rows with those of its SQL in DuckDB."""

import decimal
import os

import duckdb


def key(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return float(v) if isinstance(v, decimal.Decimal) else v


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def same(df, con, sql):
    cols = sorted(df.columns)
    got = sorted(repr(tuple(key(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(repr(tuple(key(r[i]) for i in at)) for r in cur.fetchall())
    assert got == want
