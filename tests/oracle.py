"""Compares queries with their SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of_duckdb(sf, sql):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return [rel.columns[i] for i in order], [str(rel.types[i]) for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)


KIND = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, sf, name, query, sql):
    df = query(spark, sf)
    columns = sorted(df.columns)
    kinds = [KIND.get(dict(df.dtypes)[c], dict(df.dtypes)[c]) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.select(*columns).collect()), key=repr)
    want_columns, want_kinds, want = rows_of_duckdb(sf, sql)
    assert columns == want_columns, (name, columns, want_columns)
    assert [k for k in kinds] == [k if k in KIND.values() else g for k, g in zip(want_kinds, kinds, strict=True)], (name, kinds, want_kinds)
    assert len(got) == len(want), (name, len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (name, a, b)
    return len(got)
