"""Runs a query and its SQL on the same Parquet files and compares types and rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_plain(v) for v in row) for row in zip(*columns, strict=True)]
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


def _types(table) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "") for f in table.schema}


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences in column types, row count and values; empty when equal."""
    got, want = df.toArrow(), con.sql(sql).to_arrow_table()
    problems = []
    if _types(got) != _types(want):
        a, b = _types(got), _types(want)
        problems += [
            f"type of {n}: {a.get(n)} against {b.get(n)}"
            for n in sorted(a.keys() | b.keys())
            if a.get(n) != b.get(n)
        ]
    if got.num_rows != want.num_rows:
        problems.append(f"{got.num_rows} rows against {want.num_rows}")
    if sorted(got.column_names) == sorted(want.column_names):
        left, right = _rows(got), _rows(want)
        if left != right:
            pairs = [(x, y) for x, y in zip(left, right, strict=False) if x != y]
            problems.append(f"{len(pairs)} rows differ, first: {pairs[:1]}")
    return problems
