"""Compares a registered query with its SQL in DuckDB, as multisets of rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, int):
        return v
    return str(v)


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def same(spark, sf, query, sql):
    df = query(spark, sf)
    names = sorted(df.columns)
    got = [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in map(_plain, r)) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    rel = duck(sf).sql(sql)
    assert sorted(rel.columns) == names, (names, rel.columns)
    want = [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in map(_plain, r)) for r in rel.select(*[f'"{c}"' for c in names]).fetchall()]
    return sorted(got, key=_key), sorted(want, key=_key)
