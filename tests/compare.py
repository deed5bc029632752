"""Run a registered query on Spark and its SQL in DuckDB; compare as sorted rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else repr(float(v))
    return str(v)


def normalized(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_result(df):
    return normalized(df.columns, [tuple(r) for r in df.collect()])


def sql_result(con, sql: str):
    result = con.execute(sql)
    return normalized([d[0] for d in result.description], result.fetchall())


def difference(left, right, limit: int = 3) -> str | None:
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] == right[1]:
        return None
    only_left = sorted(set(left[1]) - set(right[1]))[:limit]
    only_right = sorted(set(right[1]) - set(left[1]))[:limit]
    return f"{len(left[1])} rows vs {len(right[1])}; spark only {only_left}; sql only {only_right}"
