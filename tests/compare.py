"""Row comparison of a Spark result and a DuckDB result, whatever the order."""

from __future__ import annotations

import math
import os

import duckdb


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "tolist"):
        return value.tolist()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def same(df, sql: str, folder: str) -> None:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    expected = rows_of(columns, got.fetchall())
    assert sorted(df.columns) == sorted(columns)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(found) == len(expected)
    assert found == expected
