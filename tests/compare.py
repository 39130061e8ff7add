"""Compare a Spark result with DuckDB on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _value(v):
    if v is None:
        return "\0"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(_value(r[i]) for i in order) for r in rows
    )


def difference(df, con, sql) -> str:
    """Empty string when equal, else a short description."""
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs = normal([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if mine[1] == theirs[1]:
        return ""
    a, b = set(mine[1]), set(theirs[1])
    return (
        f"rows {len(mine[1])} vs {len(theirs[1])}; "
        f"only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    )
