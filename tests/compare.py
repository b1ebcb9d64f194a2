"""Compare a query with its SQL on the same Parquet tables."""

from __future__ import annotations

import collections
import math

import duckdb

TABLES = """region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations""".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 9)
    return x


def bag(columns: list[str], rows) -> collections.Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str):
    """``(n_spark, n_sql, only_spark, only_sql)`` with a few differing rows."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = bag(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    got = bag(df.columns, df.collect())
    return sum(got.values()), sum(want.values()), list((got - want).items()), list((want - got).items())
