"""Compare a Spark result with a DuckDB statement: columns, row count, values."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _kind(spark_type: str) -> str:
    base = spark_type.split("(")[0]
    return {"bigint": "int", "int": "int", "integer": "int", "hugeint": "int", "double": "float",
            "varchar": "string", "timestamp_ntz": "timestamp"}.get(base, base)


def differences(df, con, sql: str) -> list[str]:
    """Empty when equal; otherwise what differs."""
    names = sorted(df.columns)
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    if sorted(columns) != names:
        return [f"columns {sorted(columns)} != {names}"]
    rows = result.fetchall()
    problems = []
    spark_types = {n: _kind(t) for n, t in df.dtypes}
    duck_types = {c[0]: _kind(str(c[1]).lower()) for c in result.description}
    for n in names:
        if spark_types[n] != duck_types[n]:
            problems.append(f"type of {n}: {spark_types[n]} != {duck_types[n]}")
    at = [columns.index(n) for n in names]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in rows)
    got = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    if got != want:
        extra, missing = list((got - want).elements()), list((want - got).elements())
        problems.append(f"{len(extra)} rows only in Spark, {len(missing)} only in DuckDB "
                        f"(of {sum(want.values())}); {names}: {extra[:2]} / {missing[:2]}")
    return problems


def in_order(con, sql: str, columns: list[str]) -> list[tuple]:
    """Rows of a statement in its order, with the columns in the order given."""
    result = con.execute(sql)
    at = [[c[0] for c in result.description].index(n) for n in columns]
    return [tuple(r[i] for i in at) for r in result.fetchall()]
