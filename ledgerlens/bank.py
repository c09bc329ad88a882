"""The ten bank tables as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.schema import EVENT_TABLES, TABLES
from ledgerlens.sources.catalog import read_table
from ledgerlens.sources.files import read_csv, read_exported_parquet, require_tables


class Bank(Mapping[str, DataFrame]):
    """Name to DataFrame; a table is opened on first use and never collected."""

    def __init__(self, load: Callable[[str], DataFrame], spark: SparkSession):
        self._load = load
        self._open: dict[str, DataFrame] = {}
        self.spark = spark

    def __getitem__(self, table: str) -> DataFrame:
        if table not in TABLES:
            raise KeyError(table)
        if table not in self._open:
            self._open[table] = self._load(table)
        return self._open[table]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> Bank:
        """``<folder>/<table>.parquet``; raises when a table is missing."""
        require_tables(spark, folder)
        return cls(lambda t: read_exported_parquet(spark, f"{folder}/{t}.parquet", t), spark)

    @classmethod
    def from_csv(
        cls, spark: SparkSession, folder: str, suffix: str = ".csv",
        partitions: int | None = None, multiline: bool = False,
    ) -> Bank:
        """``<folder>/<table>.csv`` or, with the suffix ``.csv.gz``, gzip files.

        A gzip file is read by one task; ``partitions`` spreads the rows of event tables after it.
        """
        require_tables(spark, folder, suffix=suffix)

        def load(table: str) -> DataFrame:
            parts = partitions if table in EVENT_TABLES else None
            return read_csv(spark, f"{folder}/{table}{suffix}", table, parts, multiline)

        return cls(load, spark)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> Bank:
        return cls(lambda t: read_table(spark, f"{database}.{t}"), spark)

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: Mapping[str, DataFrame]) -> Bank:
        return cls(lambda t: frames[t], spark)
