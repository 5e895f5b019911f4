"""Compares a query's rows with its SQL in DuckDB, as sorted rows with floats rounded."""

from __future__ import annotations

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{directory}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 4) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(df, connection, sql: str) -> str:
    """Empty if the two agree, else what differs."""
    relation = connection.sql(sql)
    names = list(relation.columns)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours, theirs = sorted_rows(df.columns, df.collect()), sorted_rows(names, relation.fetchall())
    if ours == theirs:
        return ""
    extra = [r for r in ours if r not in set(theirs)][:3], [r for r in theirs if r not in set(ours)][:3]
    return f"{len(ours)} and {len(theirs)} rows; only here {extra[0]}; only there {extra[1]}"
