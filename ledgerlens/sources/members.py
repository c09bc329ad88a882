"""Gzip files of several members, read by many tasks.

Concatenated and block gzip files are a row of members, each of which can be inflated alone. No
list of them exists, so a first pass finds them: blocks of the file are searched for member heads
at the same time, and a head counts if the member behind it inflates and its checksum fits. A
second pass inflates spans of neighbouring members. A span leaves the line it begins within to the
one before, which reads on past its own end to finish that line; so nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.sources.scratch import written
from ledgerlens.sources.ship import ship

BLOCK_BYTES = 32 * 1024 * 1024
MAX_TASKS = 20_000
CHUNK = 1024 * 1024
# A gzip member starts with two magic bytes, method 8 and flags below 32; window bits
# that make zlib expect such a head and check the sums at the end.
HEAD = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")
HEAD_BYTES = 4
GZIP_WINDOW = 31

LINES = pa.schema(
    [("path", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("value", pa.binary())]
)


def _open(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, inner = pa.fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_file(inner)


def _read(file: pa.NativeFile, at: int, size: int = CHUNK) -> bytes:
    file.seek(at)
    return file.read(size)


def _inflate(file: pa.NativeFile, start: int) -> Iterator[tuple[bytes, int]]:
    """Content of the member at ``start`` in chunks, each with 0; last, no bytes and the member's end.

    Zeros that pad a member belong to it. Raises ``zlib.error`` where there is no whole member.
    """
    inflater, at = zlib.decompressobj(GZIP_WINDOW), start
    while not inflater.eof:
        data = _read(file, at)
        if not data:
            raise zlib.error(f"the member at byte {start} is cut off")
        at += len(data)
        while True:
            out = inflater.decompress(data, CHUNK)
            data = inflater.unconsumed_tail
            if out:
                yield out, 0
            if inflater.eof or not (data or len(out) == CHUNK):
                break
    end = at - len(inflater.unused_data)
    while padding := _read(file, end):
        rest = padding.lstrip(b"\0")
        end += len(padding) - len(rest)
        if rest:
            break
    yield b"", end


def _end(file: pa.NativeFile, start: int) -> int | None:
    """Where the member at ``start`` ends; None if there is no whole one."""
    end = None
    try:
        for _, end in _inflate(file, start):
            pass
    except zlib.error:
        return None
    return end


def _starting_within(file: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Start and end of members whose head begins in ``[start, stop)``."""
    at = start
    while at < stop:
        data = _read(file, at, min(CHUNK, stop - at) + HEAD_BYTES - 1)
        found = HEAD.search(data)
        while found and at + found.start() < stop:
            end = _end(file, at + found.start())
            if end is not None:
                yield at + found.start(), end
                at = end
                break
            found = HEAD.search(data, found.start() + 1)
        else:
            at += CHUNK


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        for block in batch.to_pylist():
            with _open(block["path"]) as file:
                found = list(_starting_within(file, block["first"], block["stop"]))
            rows = [{"path": block["path"], "start": s, "end": e} for s, e in found]
            yield pa.RecordBatch.from_pylist(rows, schema)


def _spread(df: DataFrame) -> DataFrame:
    """A row to a task, as far as that makes no more than ``MAX_TASKS``."""
    return df.coalesce(1).repartition(max(1, min(df.count(), MAX_TASKS)))


def member_index(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The members of the gzip files at ``path``: (path, start, end), by bytes of the file.

    Members must follow each other from the first byte to the last; a file in which they do not,
    be it cut off, damaged within or no gzip file, raises ``OSError``. Only the index is sorted per file, one row
    per member.
    """
    ship(spark)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    listed = listing.load(path).select("path", "length")
    starts = F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(block_bytes).cast("bigint")))
    blocks = listed.filter("length > 0").select("path", starts.alias("first"), "length")
    stop = F.least("length", F.col("first") + block_bytes).alias("stop")
    blocks = _spread(blocks.select("path", "first", stop))
    heads = written(blocks.mapInArrow(_find, "path string, start bigint, end bigint"), "gzip-heads")
    # A gzip file that is stored within a member has heads of its own; they lie before its end.
    ahead = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(ahead), F.lit(0))
    index = heads.withColumn("_reached", reached).filter("start >= _reached").drop("_reached")
    covered = index.groupBy("path").agg(F.sum(F.col("end") - F.col("start")).alias("_covered"))
    damaged = listed.join(covered, "path", "left").filter("coalesce(_covered, 0) <> length").first()
    if damaged:
        raise OSError(
            f"{damaged.path}: whole gzip members cover {damaged._covered or 0} of {damaged.length} bytes"
        )
    return index


def _lines(file: pa.NativeFile, start: int, end: int) -> Iterator[list[bytes]]:
    """Lines that follow a line break in members from ``start`` to ``end``, or start the file."""
    size, at, parts, mine = file.size(), start, [], start == 0
    while at < size:
        beyond = at >= end
        if beyond and not mine:
            return
        for out, after in _inflate(file, at):
            if not mine:
                _, broken, out = out.partition(b"\n")
                mine = bool(broken)
            if beyond:
                head, broken, _ = out.partition(b"\n")
                parts.append(head)
                if broken:
                    yield [b"".join(parts)]
                    return
            elif mine:
                *whole, last = out.split(b"\n")
                if whole:
                    whole[0] = b"".join([*parts, whole[0]])
                    yield whole
                    parts = []
                parts.append(last)
        at = after
    if any(parts):
        yield [b"".join(parts)]


def _read_spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for span in batch.to_pylist():
            line = 0
            with _open(span["path"]) as file:
                for values in _lines(file, span["start"], span["end"]):
                    n = len(values)
                    places = [[span["path"]] * n, [span["start"]] * n, range(line, line + n), values]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, t) for v, t in zip(places, LINES.types, strict=True)], schema=LINES
                    )
                    line += n


def read_lines(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Lines of the gzip files at ``path`` as (path, block, line, value), each without its line break.

    ``block`` is the byte at which a span of members starts, about ``block_bytes`` of them
    compressed, and ``line`` a number within it. A file of one member is read by one task.
    """
    index = member_index(spark, path, block_bytes)
    spans = index.groupBy("path", F.floor(F.col("start") / block_bytes).alias("_block")).agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )
    spans = _spread(written(spans.drop("_block"), "gzip-spans"))
    lines = spans.mapInArrow(_read_spans, "path string, block bigint, line bigint, value binary")
    return lines.withColumn("value", F.col("value").cast("string"))
