"""Compares a query with its SQL, as sorted rows under sorted column names."""

from __future__ import annotations

import os
from functools import cache

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@cache
def connection(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def same(spark, folder: str, query, sql: str) -> None:
    df = query(spark, folder)
    found = connection(folder).sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    order = [found.columns.index(c) for c in sorted(found.columns)]
    mine = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    assert mine == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())
