"""Compares a query's rows with those of its DuckDB text."""

from __future__ import annotations

from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def oracle_rows(sql: str, data: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as db:
        for path in Path(data).glob("*.parquet"):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        found = db.execute(sql)
        return [c[0] for c in found.description], found.fetchall()


def _key(row: tuple) -> tuple:
    return tuple((x is None, str(type(x)) if x is None else "", x if x is not None else 0) for x in row)


def assert_same(df: DataFrame, sql: str, data: str) -> None:
    names, expected = oracle_rows(sql, data)
    assert sorted(df.columns) == sorted(names)
    rows = [tuple(r) for r in df.select(*names).collect()]
    assert len(rows) == len(expected)
    assert sorted(rows, key=_key) == sorted(expected, key=_key)
