"""WARC records in ZIP archives: written as stored members, read back by ranges.

Each task writes archives of its own into the shared folder: one member with the records, each
compressed by itself, and one index with the place of every record. Readers take the central
directory (ZIP64 included), then the index, then exactly the bytes of each record; nothing is
extracted. Only archives of tasks that finished are listed, so a repeated task does no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import zipread
from ledgerlens.llm.common import read_table, written
from ledgerlens.sources.scratch import new_folder

LEAST_BYTES = 0
"""Payload size from which equal payloads are written once."""
ARCHIVE_BYTES = 256 << 20
"""Size from which a task begins another archive."""
RANGE_BYTES = 4 << 20
"""Neighbouring records are read together up to this size."""
RANGES_PER_TASK = 2
RECORDS, INDEX = "archive/records.warc.gz", "indexes/index.jsonl"
FORM = "WARC/1.1"


def digest_of(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(fields: list[tuple[str, object]]) -> bytes:
    return "".join([f"{FORM}\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has no payload, but its digest and length."""
    name = "" if page_id is None else str(page_id)
    body = b"" if refers_to is not None else payload
    # Blanks and controls in a URL would break the header.
    target = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", len(payload)),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields += [("WARC-Profile", profile), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return _head([*fields, ("Content-Length", len(body))]) + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and content block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != FORM:
        raise zipread.BadArchive("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line) | {
        line[:-1].rstrip(): "" for line in lines[1:] if line.rstrip().endswith(":")
    }
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise zipread.BadArchive("record length is wrong")
    return fields, rest[:size]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


class _Archive:
    """One ZIP file in the making."""

    def __init__(self, folder: str):
        self.name = f"{uuid.uuid4().hex}.zip"
        system, path = _open(folder)
        self.stream = system.open_output_stream(f"{path}/{self.name}")
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(RECORDS, "w", force_zip64=True)
        self.places: list[tuple[int, int]] = []
        self.size = 0

    def add(self, raw: bytes) -> None:
        data = gzip.compress(raw, 6, mtime=0)
        self.member.write(data)
        self.places.append((self.size, len(data)))
        self.size += len(data)

    def close(self) -> str:
        self.member.close()
        lines = (json.dumps({"offset": o, "length": n}) for o, n in self.places)
        self.zip.writestr(INDEX, "\n".join(lines))
        self.zip.close()
        self.stream.close()
        return self.name


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, names = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, html, digest, refers_to = row
                archive = archive or _Archive(folder)
                payload = (html or "").encode("utf-8", "surrogatepass")
                archive.add(record(page_id, url, payload, digest, refers_to))
                if archive.size >= ARCHIVE_BYTES:
                    names.append(archive.close())
                    archive = None
        if archive:
            names.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["archive"])

    return run


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five digits make four letters."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def four(i: Column) -> Column:
        n = F.conv(F.substring(hexed, 5 * i + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(
            *[
                F.substring(F.lit(alphabet), F.shiftright(n, by).bitwiseAND(31) + 1, F.lit(1))
                for by in (15, 10, 5, 0)
            ]
        )

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def write(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Archives of all ``pages (page_id, url, html)`` in ``folder``; returns their names.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is written
    whole and the others refer to it; rows repeated under that page_id are written whole too. Rows
    without page_id refer to one that has it, and are written whole where none has.
    """
    page = F.col("page_id").cast("long")
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(page.alias("page_id"), "url", "html", base32(F.sha1(payload)).alias("digest"))
    first = rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("rows"))
    # Only payloads that occur again need a look-up; the table stays small beside the pages.
    first = written(first.filter("rows > 1").drop("rows"), "payloads")
    again = (F.octet_length(payload) >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(again, F.col("first")).alias("refers_to")
    )
    return written(rows.mapInArrow(_write(folder), "archive string"), "archives")


def _reader(folder: str, name: str):
    system, path = _open(folder)
    stream = system.open_input_file(f"{path}/{name}")

    def read_at(offset: int, length: int) -> bytes:
        stream.seek(offset)
        return stream.read(length)

    return read_at, stream.size()


def _places(folder: str):
    """Ranges of neighbouring records of each archive, from its directory and index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                read_at, size = _reader(folder, name)
                held = {m.name: m for m in zipread.members(read_at, size)}
                index = held[INDEX]
                raw = read_at(zipread.data_offset(read_at, index), index.size)
                start = zipread.data_offset(read_at, held[RECORDS])
                ranges: list[list] = []
                for line in raw.splitlines():
                    place = json.loads(line)
                    if not ranges or ranges[-1][1] + place["length"] > RANGE_BYTES:
                        ranges.append([start + place["offset"], 0, []])
                    ranges[-1][1] += place["length"]
                    ranges[-1][2].append(place["length"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(ranges), pa.string()),
                        pa.array([r[0] for r in ranges], pa.int64()),
                        pa.array([r[2] for r in ranges], pa.list_(pa.int64())),
                    ],
                    names=["archive", "offset", "lengths"],
                )

    return run


RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _read(folder: str, with_payload: bool):
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, offset, lengths in zip(
                *(batch.column(c).to_pylist() for c in ("archive", "offset", "lengths")), strict=True
            ):
                read_at, _ = _reader(folder, name)
                raw, at, rows = read_at(offset, sum(lengths)), 0, []
                for length in lengths:
                    fields, payload = parsed(gzip.decompress(raw[at : at + length]))
                    at += length
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if kind == "response" and digest != digest_of(payload):
                        raise zipread.BadArchive(f"payload digest of a record in {name} is wrong")
                    rows.append(
                        (
                            _page(fields["WARC-Record-ID"]),
                            fields["WARC-Target-URI"],
                            int(fields["WARC-Payload-Length"]),
                            digest,
                            kind,
                            _page(fields.get("WARC-Refers-To")),
                            payload if with_payload and kind == "response" else None,
                        )
                    )
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names
                )

    return run


def read(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of ``archives (archive)`` in ``folder``; payloads are checked and may be left out."""
    ranges = archives.mapInArrow(_places(folder), "archive string, offset long, lengths array<long>")
    # A few ranges a task, whatever the size of the archives; a number of its own keeps the few,
    # small rows from being put into one task.
    spread = written(ranges, "ranges")
    tasks = max(1, -(-spread.count() // RANGES_PER_TASK))
    dealt = spread.repartition(tasks, F.xxhash64("archive", "offset"))
    return dealt.mapInArrow(_read(folder, with_payload), RECORD)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back, without their payloads."""
    folder = new_folder(spark, "warc")
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    archives = write(read_table(spark, sf_dir, "pages"), folder)
    return read(archives, folder, with_payload=False).drop("url", "payload")


SQL = """
WITH hashed AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
    SELECT page_id, html, array_to_string(list_transform(range(0, 8), lambda i:
        array_to_string(list_transform([15, 10, 5, 0], lambda b:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (((('0x' || substr(h, (5 * i + 1)::INT, 5))::INT >> b::INT) & 31) + 1)::INT, 1)), '')), '')
        AS digest FROM hashed),
firsts AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM coded)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM firsts
"""
