"""Rows of a query in Spark against its SQL in DuckDB, as the driver compares them."""

import math

import duckdb

from orbweave.sources.tables import TABLES


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(0.0 if v == 0 else v)
    return str(v)


def differences(duck, sql, columns, rows):
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(columns):
        return [(sorted(columns), sorted(names))]
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    got = sorted(tuple(plain(v) for v in r) for r in rows)
    if len(got) != len(want):
        return [(len(got), len(want))]
    return [(g, w) for g, w in zip(got, want) if g != w]
