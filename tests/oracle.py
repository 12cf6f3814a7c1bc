"""Queries against their SQL in DuckDB."""

import datetime
import decimal
import math
import os


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return v


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def same(spark, con, query, sql, folder):
    df = query(spark, folder)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows_of(df.collect(), df.columns), rows_of(rel.fetchall(), rel.columns)
    assert got == want
    return len(got)
