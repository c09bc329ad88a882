"""Small driver-side rows as a distributed table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def from_local(spark: SparkSession, rows: Iterable[tuple], ddl: str) -> DataFrame:
    """``rows`` must be few (status logs, lookups); the schema is explicit, never inferred."""
    return spark.createDataFrame(list(rows), ddl)
