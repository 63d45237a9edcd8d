"""Side-by-side comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb
from pyspark.sql import SparkSession


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return v


def rows(columns: list[str], found: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, make, sql: str | None, sf_dir: str) -> str:
    """'' if both give the same rows, else what differs."""
    df = make(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    if sql is None:
        return "" if mine else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    wide = [d[0] for d in cursor.description if str(d[1]) == "HUGEINT" or str(d[1]).startswith("DECIMAL")]
    if wide:
        return f"SQL gives columns of types that Spark doesn't: {wide}"
    if list(map(repr, mine)) != list(map(repr, theirs)):
        odd = [(a, b) for a, b in zip(mine, theirs, strict=False) if repr(a) != repr(b)][:3]
        return f"{len(mine)} and {len(theirs)} rows, first differences {odd}"
    return ""
