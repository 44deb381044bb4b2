"""Compare a Spark result with DuckDB's over the same files."""

import datetime
import decimal
import glob
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def check(spark, sf, query, sql):
    df = query(spark, sf)
    mine = [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    theirs = [tuple(r[i] for i in order) for r in found.fetchall()]
    key = lambda r: repr([norm(v) for v in r])
    assert sorted(map(key, mine)) == sorted(map(key, theirs))
