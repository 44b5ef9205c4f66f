"""Compares a Spark result with DuckDB SQL over the same tables."""

import datetime
import decimal
import math

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(float(v)) else float(f"{float(v):.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in (v.asDict().values() if hasattr(v, "asDict") else v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def same(spark, query, sql, data=DATA):
    df = query(spark, data)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*columns).collect())
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    expect = sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    assert got == expect
