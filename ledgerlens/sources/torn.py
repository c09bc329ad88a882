"""CSV whose quoted fields hold line breaks, read by many tasks.

Where a record ends depends on every quote before it, so a file seems to need one reader. It needs
only the parity of quotes ahead of each block: blocks are read as plain lines, each block counts
its own quotes, and a sum over one row per block tells whether it starts inside quotes. Lines that
are whole records stay where they were read. Only records torn over several lines are shuffled, by
the line they start at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.sources.ship import ship

BLOCK = ["path", "block"]
MARKS = "path string, block bigint, line int, quotes int, inside int, head_0 int, head_1 int"
NO_HEAD = -1


def _place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of every block and follow the parity of quotes within it.

    ``inside`` is the parity ahead of a line, counted from the start of its block. ``head_0`` and
    ``head_1`` are the last line up to this one that starts a record if the block itself starts
    outside or inside quotes, -1 if there is none. Only these four numbers pass between batches.
    """
    block, line, odd, heads = None, 0, 0, [NO_HEAD, NO_HEAD]
    for batch in batches:
        paths, starts = batch["path"], batch["block"].to_numpy()
        quotes = batch["quotes"].to_numpy().astype(np.int64)
        n = len(quotes)
        if not n:
            continue
        # A task reads its blocks one after the other.
        fresh = np.ones(n, bool)
        same_path = pa.compute.equal(paths[1:], paths[:-1]).to_numpy(zero_copy_only=False)
        fresh[1:] = ~same_path | (starts[1:] != starts[:-1])
        firsts = np.flatnonzero(fresh)
        numbers, inside = np.empty(n, np.int32), np.empty(n, np.int32)
        found = [np.empty(n, np.int32), np.empty(n, np.int32)]
        for first, end in zip(firsts, [*firsts[1:], n], strict=True):
            here = (paths[int(first)].as_py(), int(starts[first]))
            if here != block:
                block, line, odd, heads = here, 0, 0, [NO_HEAD, NO_HEAD]
            after = odd + np.cumsum(quotes[first:end])
            before = (after - quotes[first:end]) % 2
            numbers[first:end] = np.arange(line, line + end - first)
            inside[first:end] = before
            for parity in (0, 1):
                own = np.where(before == parity, numbers[first:end], heads[parity])
                found[parity][first:end] = np.maximum.accumulate(own)
                heads[parity] = int(found[parity][end - 1])
            line, odd = line + int(end - first), int(after[-1] % 2)
        added = {"line": numbers, "inside": inside, "head_0": found[0], "head_1": found[1]}
        yield pa.RecordBatch.from_pydict(
            {name: batch[name] for name in batch.schema.names}
            | {name: pa.array(values, pa.int32()) for name, values in added.items()}
        )


def _ordered(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def block_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as (path, block, value); every line is in the block it starts in."""
    raw = spark.read.option("lineSep", "\n").text(path)
    place = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    return raw.select(*place, "value")


def _marked(lines: DataFrame, with_text: bool) -> DataFrame:
    """Lines with their place; without the texts where only blocks are to be added up."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.select(*BLOCK, quotes.cast("int").alias("quotes"), *(["value"] if with_text else []))
    schema = MARKS + (", value string" if with_text else "")
    names = _ordered(schema)
    placed = lambda batches: (b.select(names) for b in _place(batches))
    return lines.mapInArrow(placed, schema)


def _head(parity: Column, *heads: Column) -> Column:
    """The line a record starts at, by the parity its block starts with; null if not in it."""
    return F.nullif(F.when(parity == 0, heads[0]).otherwise(heads[1]), F.lit(NO_HEAD))


def _blocks(lines: DataFrame) -> DataFrame:
    """One row per block: the parity it starts with and the record still open there."""
    own = _marked(lines, with_text=False).groupBy(*BLOCK).agg(
        (F.sum("quotes") % 2).alias("odd"),
        F.max("head_0").alias("last_0"),
        F.max("head_1").alias("last_1"),
    )
    # A file has one row here per block, not per line.
    in_file = Window.partitionBy("path")
    ahead = in_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.withColumn("parity", F.coalesce(F.sum("odd").over(ahead), F.lit(0)) % 2)
    starts = starts.withColumn("last", _head(F.col("parity"), F.col("last_0"), F.col("last_1")))
    opened = F.when(F.col("last").isNotNull(), F.struct("block", F.col("last").alias("line")))
    return starts.select(
        *BLOCK,
        "parity",
        F.last(opened, ignorenulls=True).over(ahead).alias("opened"),
        (F.sum("odd").over(in_file) % 2 == 0).alias("closed"),
    )


def read_records(lines: DataFrame) -> DataFrame:
    """Every record of CSV files as one text, line breaks inside quotes included.

    ``lines`` are those of :func:`block_lines` or ``members.read_lines``: lines of a block reach
    the same task one after the other.

    Records come as (path, block, line, record), by the line they start at; the first of each file
    is the header, with ``block`` and ``line`` 0. Empty lines outside quotes are no records. The
    carriage return of a record's last line is dropped, those inside quotes stay. A quote opens and
    closes a field and is doubled inside it; a file in which the last quote is never closed is an
    error, as it would turn the rest of the file into one field.
    """
    ship(lines.sparkSession)
    placed = _marked(lines, with_text=True).join(_blocks(lines), BLOCK, "left")
    own = _head(F.col("parity"), F.col("head_0"), F.col("head_1"))
    before = (F.col("inside") + F.col("parity")) % 2
    starts, ends = before == 0, (before + F.col("quotes")) % 2 == 0
    unclosed = F.concat(F.lit("a quote is never closed in "), F.col("path"))
    value = F.when(F.col("closed"), F.col("value")).otherwise(F.raise_error(unclosed))
    whole = placed.filter(starts & ends).select(*BLOCK, "line", value.alias("record"))
    start = F.when(own.isNotNull(), F.struct("block", own.alias("line"))).otherwise(F.col("opened"))
    torn = (
        placed.filter(~(starts & ends))
        .select("path", start.alias("start"), F.struct("block", "line", value.alias("value")).alias("part"))
        .groupBy("path", "start")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .select("path", "start.*", F.array_join("parts.value", "\n").alias("record"))
    )
    records = whole.unionByName(torn)
    records = records.withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return records.filter(F.col("record") != "")


def read_torn_fields(lines: DataFrame, columns: list[str], options: dict) -> DataFrame:
    """The fields of :func:`read_records` below their headers, every one as text.

    ``columns`` are the names in the header, ``options`` those of Spark's CSV parser.
    """
    return parse_records(read_records(lines), columns, options)


def parse_records(records: DataFrame, columns: list[str], options: dict) -> DataFrame:
    """Fields of (block, line, record) but for the first record of each file, its header."""
    body = records.filter("NOT (block = 0 AND line = 0)")
    fields = [f"c{i}" for i in range(len(columns))]
    schema = ", ".join(f"{f} string" for f in fields)
    row = F.from_csv("record", schema, {k: str(v) for k, v in options.items()} | {"multiLine": "true"})
    return body.select(row.alias("row")).select(
        *(F.col("row")[f].alias(c) for f, c in zip(fields, columns, strict=True))
    )
