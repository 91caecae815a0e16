"""Running a query and its SQL side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    if isinstance(v, list):
        return tuple(_plain(i) for i in v)
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def sql_rows(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    got = db.execute(sql)
    names = [c[0] for c in got.description]
    return sorted(names), rows_of(names, got.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())
