"""Compares a registered query with its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return (sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in rows),
                                  key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0)
                                                      for v in r)))


def spark_rows(df):
    return _rows(df.columns, df.collect())


def duck_rows(con, sql: str):
    result = con.execute(sql)
    return _rows([d[0] for d in result.description], result.fetchall())


def difference(df, con, sql: str) -> str | None:
    """None when both give the same rows, else what differs first."""
    got_names, got = spark_rows(df)
    want_names, want = duck_rows(con, sql)
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{got_names}\n spark {a}\n sql   {b}"
    return None
