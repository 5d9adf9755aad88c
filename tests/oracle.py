"""Runs a query and its SQL over the same tables and compares rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "year"):
        return str(v)[:10]
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, query, sql, sf):
    got = query(spark, sf)
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.sql(sql)
    assert sorted(got.columns) == sorted(want.columns), name
    assert rows_of(got.columns, map(tuple, got.collect())) == rows_of(want.columns, want.fetchall()), name
