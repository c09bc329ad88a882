"""Catalog databases and managed tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS_DDL = "table_name string, n_rows bigint, status string, error string"


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create the database unless it exists."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{_identifier(name)}`{where}")


def show_database(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"SHOW DATABASES LIKE '{_identifier(name)}'")


#: Key of the event tables that analyses group and join by, for bucketed tables.
BUCKET_KEYS = {
    "card_transaction": "CARD_ID",
    "transaction_list": "ACCOUNT_ID",
    "loan_payment": "LOAN_ID",
}


def save_table(
    df: DataFrame, name: str, fmt: str = "parquet", key: str | None = None, buckets: int = 0
) -> None:
    """Overwrite a managed table ``[database.]table``: a table beside it takes its place when whole.

    A write that fails leaves the old rows as they are; the version before stays as
    ``<table>__previous``. With ``buckets`` the rows are bucketed and sorted by ``key``, so that
    grouping and joining by it need no shuffle of the table. Formats beyond the built-in ones need
    their jar.
    """
    spark = df.sparkSession
    *database, table = re.findall(r"\w+", name)
    quoted = lambda t: ".".join(f"`{p}`" for p in (*database, t))
    staged, previous = f"{table}__staged_{uuid.uuid4().hex}", f"{table}__previous"
    writer = df.write.format(fmt)
    if buckets:
        writer = writer.bucketBy(buckets, key).sortBy(key)
    try:
        writer.saveAsTable(quoted(staged))
        spark.read.table(quoted(staged)).count()
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {quoted(staged)}")
        raise
    there = spark.catalog.tableExists(quoted(table))
    if there:
        spark.sql(f"DROP TABLE IF EXISTS {quoted(previous)}")
        spark.sql(f"ALTER TABLE {quoted(table)} RENAME TO {quoted(previous)}")
    try:
        spark.sql(f"ALTER TABLE {quoted(staged)} RENAME TO {quoted(table)}")
    except Exception:
        if there:
            spark.sql(f"ALTER TABLE {quoted(previous)} RENAME TO {quoted(table)}")
        raise


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table as one query: a union of one-row counts."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in frames.items()
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result


def total_rows(frames: Mapping[str, DataFrame]) -> DataFrame:
    return row_counts(frames).agg(F.sum("n_rows").alias("total_rows"))


def ingest_all(
    spark: SparkSession,
    loaders: Mapping[str, Callable[[], DataFrame]],
    database: str,
    fmt: str = "parquet",
    buckets: int = 0,
) -> DataFrame:
    """Load every table into ``database``; one failing table does not stop the others.

    A table that fails keeps the rows it had. With ``buckets`` the event tables are bucketed by the
    keys of ``BUCKET_KEYS``.

    Rows are counted in the written table, where a columnar format answers from its footers. The
    result has one status row per table.
    """
    log = []
    for table, load in loaders.items():
        name = f"`{_identifier(database)}`.`{_identifier(table)}`"
        try:
            key = BUCKET_KEYS.get(table)
            save_table(load(), name, fmt, key, buckets if key else 0)
            log.append((table, read_table(spark, name).count(), "ok", None))
        except Exception as error:  # noqa: BLE001 - whatever is wrong with a table stays its own
            reason = str(error).strip().splitlines()
            log.append((table, None, "failed", reason[0] if reason else type(error).__name__))
    return spark.createDataFrame(log, STATUS_DDL)


def _identifier(name: str) -> str:
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"not a plain identifier: {name!r}")
    return name
