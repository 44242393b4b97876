"""Runs a query in Spark and its SQL in DuckDB and compares names, types and rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return Counter(tuple(_plain(v) for v in row) for row in zip(*columns)) if columns else Counter()


def _kinds(table):
    def kind(t):
        return str(t).replace("large_", "").replace("element", "l").replace("child", "l").replace(" not null", "")

    return {f.name: kind(f.type) for f in table.schema}


def compare(spark_table, duck_table) -> str | None:
    """None when equal, otherwise what differs."""
    ours, theirs = _kinds(spark_table), _kinds(duck_table)
    if ours != theirs:
        return f"schema: {sorted(set(ours.items()) ^ set(theirs.items()))}"
    if spark_table.num_rows != duck_table.num_rows:
        return f"rows: spark {spark_table.num_rows}, sql {duck_table.num_rows}"
    a, b = _rows(spark_table), _rows(duck_table)
    if a != b:
        only_a, only_b = list((a - b).items()), list((b - a).items())
        key = lambda r: str(r)
        return f"values ({len(only_a)}): spark {sorted(only_a, key=key)[:3]} sql {sorted(only_b, key=key)[:3]}"
    return None
