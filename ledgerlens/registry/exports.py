"""Exports of the test bank that the source and sink queries read back."""

from __future__ import annotations

from collections.abc import Callable

from ledgerlens.registry.core import Context
from ledgerlens.schema import EVENT_TABLES, TABLES
from ledgerlens.sources import catalog
from ledgerlens.sources.files import codec_for, write_csv, write_parquet
from ledgerlens.sources.scratch import new_folder

DATABASE = "ledgerlens_check"

_done: dict[tuple[str, str, str], str] = {}


def _once(kind: str, context: Context, write: Callable[[str], None]) -> str:
    """Folder of the export, written on first use in this application."""
    key = (context.spark.sparkContext.applicationId, context.sf_dir, kind)
    if key not in _done:
        folder = new_folder(context.spark, kind)
        write(folder)
        _done[key] = folder
    return _done[key]


def parquet_folder(context: Context) -> str:
    def write(folder: str) -> None:
        for table in TABLES:
            write_parquet(context[table], f"{folder}/{table}.parquet", codec_for(table))

    return _once("parquet", context, write)


def csv_path(context: Context, table: str) -> str:
    """CSV export of one table; event tables are gzip files."""
    gzip = table in EVENT_TABLES
    suffix = ".csv.gz" if gzip else ".csv"

    def write(folder: str) -> None:
        write_csv(context[table], f"{folder}/{table}{suffix}", gzip)

    return f"{_once('csv-' + table, context, write)}/{table}{suffix}"


def database(context: Context) -> str:
    """A scratch database below the shared folder."""
    catalog.create_database(context.spark, DATABASE, _once("database", context, lambda folder: None))
    return DATABASE
