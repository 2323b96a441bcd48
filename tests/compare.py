"""Compares a query with its SQL on one folder of tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x


def rows_of_sql(con, sql: str) -> list[tuple]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def rows_of_spark(df) -> list[tuple]:
    order = sorted(df.columns)
    return order, sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=repr)
