"""Runs a query on Spark and its SQL on DuckDB and compares rows without order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        p = folder / f"{t}.parquet"
        con.sql(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return (0, "")
    if isinstance(v, float):
        return (1, repr(round(v, 9)))
    return (1, str(v))


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in found)


def compare(spark, con, query, sql, folder):
    df = query(spark, str(folder))
    r = con.sql(sql)
    assert sorted(df.columns) == sorted(r.columns)
    assert rows(df.columns, df.collect()) == rows(r.columns, r.fetchall())
