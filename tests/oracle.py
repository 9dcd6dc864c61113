"""Runs a query's SQL with DuckDB on the same tables and compares all rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(rows) -> list[tuple]:
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(round(float(v), 7)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


def same(df, sql: str, sf_dir: str) -> None:
    columns = sorted(df.columns)
    found = con.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({sql})") if (con := connection(sf_dir)) else None
    assert sorted(found.columns) == columns
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(found.fetchall())
