"""Run a registered query on Spark and its SQL on DuckDB, and compare the results exactly."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return ("nan",)
        return ("n", value + 0.0)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, dt.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    if value is None:
        return ("",)
    return (type(value).__name__, str(value))


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(_cell(v) for v in row) for row in zip(*columns)) if names else []


def compare(df, con, sql: str) -> list[str]:
    """Differences between the two results; an empty list means they agree."""
    mine = df.toArrow()
    theirs = con.execute(sql).to_arrow_table()
    problems = []
    if sorted(mine.column_names) != sorted(theirs.column_names):
        return [f"columns {sorted(mine.column_names)} != {sorted(theirs.column_names)}"]
    for name in mine.column_names:
        a, b = str(mine.schema.field(name).type), str(theirs.schema.field(name).type)
        if a.replace("large_", "") != b.replace("large_", ""):
            problems.append(f"type of {name}: {a} != {b}")
    if mine.num_rows != theirs.num_rows:
        problems.append(f"rows {mine.num_rows} != {theirs.num_rows}")
    a, b = rows_of(mine), rows_of(theirs)
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b) if x != y]
        names = sorted(mine.column_names)
        problems.append(f"{len(wrong)} rows differ, columns {names}; first: {wrong[:2]}")
    if mine.num_rows == 0:
        problems.append("no rows")
    return problems
