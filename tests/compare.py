"""Run a query and its SQL on the same tables and compare whole results."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set threads to 4")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    return value


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    listed = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(listed, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def family(kind: str) -> str:
    kind = kind.lower()
    return {"string": "varchar", "int": "integer"}.get(kind, kind)


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    answer = con.execute(sql)
    sql_columns = [c[0] for c in answer.description]
    sql_types = {c[0]: family(str(c[1])) for c in answer.description}
    sql_rows = answer.fetchall()
    if sorted(df.columns) != sorted(sql_columns):
        return f"columns {sorted(df.columns)} against {sorted(sql_columns)}"
    spark_types = {f.name: family(f.dataType.simpleString()) for f in df.schema}
    if spark_types != sql_types:
        return f"types {sorted(set(spark_types.items()) ^ set(sql_types.items()))}"
    left = normal(df.columns, df.collect())
    right = normal(sql_columns, sql_rows)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first {bad[0]}"
    return None
