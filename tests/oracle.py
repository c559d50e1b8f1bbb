"""Comparison of a query with its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return str(v) if math.isinf(v) else f"{round(float(v), 6) + 0.0:.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(norm(r[names.index(c)]) for c in order) for r in got.fetchall())
    assert ours == theirs
