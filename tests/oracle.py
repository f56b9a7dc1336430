"""Comparison of a query with its SQL, both run on the same tables."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    if isinstance(v, Decimal):
        return str(v)
    return v


def _order(row):
    return tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in row)


def _sorted_rows(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=_order)


def difference(df, con, sql: str) -> str | None:
    """None when both give the same columns and the same rows."""
    spark_names, spark_rows = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    sql_names, sql_rows = _sorted_rows([d[0] for d in cur.description], cur.fetchall())
    if spark_names != sql_names:
        return f"columns {spark_names} against {sql_names}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows against {len(sql_rows)}"
    for a, b in zip(spark_rows, sql_rows):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"first difference {a} against {b}"
    return None
