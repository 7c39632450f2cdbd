"""Compare a Spark result with DuckDB on the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import os
from glob import glob

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """Values as they compare; booleans stay apart from numbers."""
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, decimal.Decimal):
        return ("n", float(value))
    if isinstance(value, (int, float)):
        return ("n", round(float(value), 9))
    if isinstance(value, dt.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    if isinstance(value, list):
        return ("l", tuple(plain(v) for v in value))
    return ("s", value) if value is not None else ("0", "")


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


KIND = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
}


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both agree, else what differs first."""
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    got_cols = df.columns
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    types = {n: str(t) for n, t in zip(want_cols, [d[1] for d in cur.description])}
    for name, kind in df.dtypes:
        if types[name] == "HUGEINT" or (KIND.get(kind) and KIND[kind] != types[name]):
            return f"type of {name}: {kind} != {types[name]}"
    a, b = rows_of(got_cols, [tuple(r) for r in df.collect()]), rows_of(want_cols, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    for x, y in zip(a, b):
        if x != y:
            return f"{x}\n  != {y}"
    return None
