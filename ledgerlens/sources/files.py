"""Parquet and CSV files of the ten tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.cleaning import DATE_FORMATS, clean_headers, type_columns
from ledgerlens.schema import EVENT_TABLES, TABLES, struct_for
from ledgerlens.sources.members import BLOCK_BYTES, read_lines
from ledgerlens.sources.torn import block_lines, parse_records, read_torn_fields

# Codecs per kind of table and the size above which a file is reported.
SMALL_CODEC = "snappy"
EVENT_CODEC = "zstd"
LARGE_MB = 25
BYTES_PER_MB = 1024 * 1024

NO_VALUE = "\x00"
"""Stands for a field with nothing in it while a file is read, so that ``""`` is an empty text."""


def read_parquet(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Scan Parquet; with a table name the known schema is used and no footer is read up front."""
    reader = spark.read
    if table:
        reader = reader.schema(struct_for(table))
    return reader.parquet(path)


def read_exported_parquet(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Scan Parquet written elsewhere: any header spelling, values typed or still text."""
    return type_columns(clean_headers(spark.read.parquet(path)), table)


def read_text_fields(
    spark: SparkSession, path: str, partitions: int | None = None, multiline: bool = False,
    members: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Scan CSV with a header line, plain or gzip (by the ``.gz`` suffix), every field as text.

    A quote inside quotes is doubled, ``""`` is an empty text and nothing at all is null. Fields
    with line breaks need ``multiline``; the blocks of a file are then read by many tasks, too, see
    :mod:`ledgerlens.sources.torn`. A gzip file is read by one task, and ``partitions`` spreads the
    rows after the scan. With ``members``, gzip files of several members are read by a task for
    every ``block_bytes``, and damage is an error; see :mod:`ledgerlens.sources.members`. That
    inflates files one time more.
    """
    options = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": NO_VALUE}
    raw = spark.read.csv(path, header=True, inferSchema=False, **options)
    if members:
        lines = read_lines(spark, path, block_bytes)
        if multiline:
            raw = read_torn_fields(lines, raw.columns, options)
        else:
            record = F.regexp_replace("value", r"\r\z", "").alias("record")
            lines = lines.filter(F.col("value").rlike(r"[^\x00-\x20]")).select("block", "line", record)
            raw = parse_records(lines, raw.columns, options)
    elif multiline:
        raw = read_torn_fields(block_lines(spark, path), raw.columns, options)
    return raw.repartition(partitions) if partitions else raw


def read_csv(
    spark: SparkSession,
    path: str,
    table: str,
    partitions: int | None = None,
    multiline: bool = False,
    formats: Sequence[str] = DATE_FORMATS,
    members: bool = False,
) -> DataFrame:
    """Scan CSV and type its columns; see :func:`read_text_fields` for the file format.

    The first line of the files names the columns, so they may come in any order and spelling.
    Dates become timestamps with their time of day, numbers keep all their digits, and a value
    that cannot be read is null. ``cleaning.unread_values`` counts those.
    """
    raw = clean_headers(read_text_fields(spark, path, partitions, multiline, members))
    return type_columns(raw, table, formats)


def codec_for(table: str) -> str:
    return EVENT_CODEC if table in EVENT_TABLES else SMALL_CODEC


def write_parquet(df: DataFrame, path: str, codec: str = SMALL_CODEC) -> None:
    """Overwrite ``path``: the rows go to a folder beside it, which then takes its place.

    A write that fails, or whose files cannot be read back with the same columns, leaves the old
    files as they are. The version before stays at ``<path>.previous``, so ``df`` may even read
    from ``path``.
    """
    path = path.rstrip("/")
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", codec).parquet(staged)
        found = df.sparkSession.read.parquet(staged)
        if found.columns != df.columns:
            raise OSError(f"{staged} does not hold the columns that were written")
        found.count()
    except Exception:
        _files(df.sparkSession, staged).delete(staged)
        raise
    _files(df.sparkSession, path).replace(path, staged)


class _files:
    """Renames and deletions at the file system that holds a path."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def delete(self, path: str) -> None:
        self._system.delete(self._path(path), True)

    def _move(self, source: str, target: str) -> None:
        if not self._system.rename(self._path(source), self._path(target)):
            raise OSError(f"could not rename {source} to {target}")

    def replace(self, path: str, staged: str) -> None:
        """``staged`` becomes ``path``; what was there becomes ``<path>.previous``."""
        previous = f"{path}.previous"
        there = self._system.exists(self._path(path))
        if there:
            self.delete(previous)
            self._move(path, previous)
        try:
            self._move(staged, path)
        except Exception:
            if there:
                self._move(previous, path)
            raise


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    """Write CSV that :func:`read_text_fields` reads back as it was: quotes are doubled.

    Empty text is written in quotes and null as nothing; blanks at the ends of a field stay.
    """
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def registry_report(
    spark: SparkSession, folder: str, tables: Sequence[str] = TABLES, suffix: str = ".parquet"
) -> DataFrame:
    """One row per expected table: is there a file or folder ``<folder>/<table><suffix>``?

    Only these paths are asked for, at the file system that holds them; nothing else below the
    folder is listed and no content is read.
    """
    found = []
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{table}{suffix}")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        present = system.exists(path)
        files = system.getContentSummary(path).getFileCount() if present else 0
        found.append((table, present, files))
    return spark.createDataFrame(found, "table_name string, present boolean, n_files bigint")


def require_tables(
    spark: SparkSession, folder: str, tables: Sequence[str] = TABLES, suffix: str = ".parquet"
) -> None:
    """Raise ``FileNotFoundError`` naming every table that has no file."""
    report = registry_report(spark, folder, tables, suffix)
    missing = sorted(r.table_name for r in report.filter(~F.col("present")).collect())
    if missing:
        raise FileNotFoundError(f"no {suffix} file for: {', '.join(missing)}")


def convert_to_parquet(
    spark: SparkSession, sources: Mapping[str, str], out_folder: str, large_mb: int = LARGE_MB,
    partitions: int | None = None, multiline: bool = False,
) -> DataFrame:
    """Convert CSV files (plain or gzip) to Parquet and report rows and sizes per table.

    Fields are written as the text they are; :func:`read_exported_parquet` types them on loading.
    """
    pieces = []
    for table, source in sources.items():
        target = f"{out_folder}/{table}.parquet"
        fields = read_text_fields(spark, source, partitions, multiline)
        write_parquet(fields, target, codec_for(table))
        rows = spark.read.parquet(target).agg(F.count(F.lit(1)).alias("n_rows"))
        pieces.append(
            rows.select(
                F.lit(table).alias("table_name"),
                "n_rows",
                (_bytes(spark, source) / BYTES_PER_MB).alias("source_mb"),
                (_bytes(spark, target) / BYTES_PER_MB).alias("parquet_mb"),
            )
        )
    report = pieces[0]
    for piece in pieces[1:]:
        report = report.unionByName(piece)
    return report.withColumn(
        "status",
        F.when(F.col("parquet_mb") <= large_mb, F.lit("OK")).otherwise(F.lit("still large")),
    )


def _listing(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return reader.load(path).select("path", "length")


def _bytes(spark: SparkSession, path: str):
    """Total size of the data files below ``path`` as a scalar subquery."""
    return (
        _listing(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0)).cast("double").alias("b"))
    ).scalar()
