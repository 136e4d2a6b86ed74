"""Rows of a query beside those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def connect(folder: str = SF):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([_cell(r[i]) for i in order] for r in data)


def same(spark, query, sql, folder: str = SF):
    df = query(spark, folder)
    con = connect(folder)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())
