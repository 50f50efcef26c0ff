"""Compares registered queries with their DuckDB SQL on one data folder."""

import math
from pathlib import Path

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(df, con, sql: str) -> tuple[list, list]:
    got = con.sql(sql)
    assert sorted(df.columns) == sorted(got.columns)
    return rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(got.columns, got.fetchall())
