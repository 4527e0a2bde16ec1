"""Holding a query against its SQL in DuckDB."""

import datetime
import decimal
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, (datetime.datetime, datetime.date)) else v


def rows_of(columns, rows):
    order = sorted(columns)
    return order, sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rows), key=repr)


def by_duckdb(sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return rows_of(columns, cursor.fetchall())


def by_spark(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])
