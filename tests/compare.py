"""Compare a Spark result with the result of its SQL check."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """In-process database with the test tables as views."""
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"create view {name} as select * from '{path}'")
    return db


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def _rows(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        tuple(_plain(row[i]) for i in order) for row in rows
    )


SAME_KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN", "float": "FLOAT",
}


def difference(df, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when schema and rows agree exactly, else what differs."""
    cursor = db.execute(sql)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    names, expected = _rows([d[0] for d in cursor.description], cursor.fetchall())
    got_names, got = _rows(df.columns, df.collect())
    if names != got_names:
        return f"columns {got_names} expected {names}"
    wrong = {n: (k, kinds[n]) for n, k in df.dtypes if SAME_KIND.get(k, k) != kinds[n]}
    if wrong:
        return f"types {wrong}"
    if got != expected:
        extra, lost = got - expected, expected - got
        return (
            f"{sum(got.values())} rows, expected {sum(expected.values())}; "
            f"only here {list(extra)[:3]}, missing {list(lost)[:3]}"
        )
    return None
