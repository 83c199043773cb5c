"""Rows of Spark and DuckDB results in one comparable form."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(folder) / f"{t}.parquet"
        if path.exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(value):
    return round(float(value), 6) if isinstance(value, float) else value


def comparable(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([repr(plain(r[i])) for i in order] for r in rows))


def agree(frame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    wanted = con.sql(sql)
    assert sorted(frame.columns) == sorted(wanted.columns)
    assert comparable(frame.columns, frame.collect()) == comparable(wanted.columns, wanted.fetchall())
