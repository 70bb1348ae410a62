"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(str(_plain(r[i])) for i in order) for r in rows])


def difference(df, con, sql: str) -> str | None:
    """None when schema and rows agree, else what differs first."""
    result = con.execute(sql)
    sql_types = {c[0]: str(c[1]) for c in result.description}
    sql_rows = result.fetchall()
    spark_types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    if spark_types != sql_types:
        return f"types differ: spark {spark_types} sql {sql_types}"
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = _rows(list(sql_types), sql_rows)
    if len(ours) != len(theirs):
        return f"row counts differ: spark {len(ours)} sql {len(theirs)}"
    if not ours:
        return "both are empty"
    for a, b in zip(ours, theirs):
        if a != b:
            wrong = sum(x != y for x, y in zip(ours, theirs))
            return f"{wrong} of {len(ours)} rows differ, first: spark {a} sql {b}"
    return None
