"""Comparison of a query with its SQL in DuckDB, without regard to the order of rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v) + 0.0:.9g}" if isinstance(v, (int, float)) else str(v)


def same(df, con, sql):
    names = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*names).toLocalIterator())
    rel = con.execute(sql)
    order = [n[0] for n in rel.description]
    assert sorted(order) == names
    at = [order.index(n) for n in names]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
