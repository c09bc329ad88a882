"""Token ids in files of independently coded blocks.

Ids of all documents, in the order of doc_id, are coded by a static range asymmetric numeral
system with one frequency table for all files. A file is a head, blocks of whole documents, and at
its end an index: for every block its place, its number of ids and the documents in it. The index
is the list of checkpoints: each block can be found and decoded by itself, and is checked by
CRC-32 before and after decoding. ``table.bin`` beside the files holds the frequencies.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import rans, tokens
from ledgerlens.llm.common import read_table, slices, written
from ledgerlens.sources.scratch import new_folder

END_ID = 2
BLOCK_IDS = 1 << 17
"""Ids of a block; a longer document is a block of its own."""
BLOCKS_PER_TASK = 32
CHARS_AT_ONCE = 4_000_000
"""Characters of whole documents that a worker encodes at a time."""
TABLE = "table.bin"
FILE_MAGIC, TAIL = b"LLID0001", "<QLL8s"
TAIL_SIZE = struct.calcsize(TAIL)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


def _encoded(path: str, end_id: int, kind: str):
    """Ids of each document as bytes, in the smallest integers the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.encoder(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for part in slices([len(t) for t in texts], CHARS_AT_ONCE):
                ids, lengths = own.encode_flat(texts[part], end_id)
                ends = np.append(0, np.cumsum(lengths)) * np.dtype(kind).itemsize
                raw = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(),
                    len(lengths),
                    [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype(kind))],
                )
                names = batch.column("doc_id").slice(part.start, len(lengths))
                yield pa.RecordBatch.from_arrays([names, raw.cast(pa.binary())], ["doc_id", "ids"])

    return run


def _joined(raw: pa.Array, kind: str) -> np.ndarray:
    """Ids of all documents of a column of bytes, without a copy."""
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    size = np.dtype(kind).itemsize
    count = (int(ends[-1]) - int(ends[0])) // size
    return np.frombuffer(raw.buffers()[2], kind, count, int(ends[0])) if count else np.zeros(0, kind)


def _counts(kind: str, size: int):
    """Occurrences of each id in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_joined(batch.column("ids"), kind), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return run


def save_table(counts: np.ndarray, folder: str) -> None:
    system, path = _open(folder)
    raw = np.asarray(counts, "<i8").tobytes()
    with system.open_output_stream(f"{path}/{TABLE}") as out:
        out.write(struct.pack("<QL", len(counts), zlib.crc32(raw)) + raw)


@lru_cache(maxsize=2)
def load_table(folder: str) -> tuple[rans.Table, np.ndarray]:
    system, path = _open(folder)
    with system.open_input_file(f"{path}/{TABLE}") as file:
        raw = file.read()
    size, crc = struct.unpack_from("<QL", raw)
    if len(raw) != 12 + 8 * size or zlib.crc32(raw[12:]) != crc:
        raise rans.BadBlock("the frequency table is damaged")
    table = rans.Table.of(np.frombuffer(raw, "<i8", size, 12))
    return table, table.slots()


def _index_bytes(blocks: list[dict]) -> bytes:
    """Checkpoints: for each block offset, length, ids, documents; then ids and doc_ids of these."""
    out = [struct.pack("<L", len(blocks))]
    for b in blocks:
        known = np.array([d is not None for d in b["docs"]], np.uint8)
        names = np.array([d or 0 for d in b["docs"]], "<i8")
        out.append(struct.pack("<QQQL", b["offset"], b["length"], b["ids"], len(names)))
        out += [np.array(b["sizes"], "<i8").tobytes(), names.tobytes(), known.tobytes()]
    return b"".join(out)


def _index_blocks(raw: bytes) -> list[dict]:
    (count,) = struct.unpack_from("<L", raw)
    at, blocks = 4, []
    for _ in range(count):
        offset, length, ids, docs = struct.unpack_from("<QQQL", raw, at)
        at += 28
        sizes = np.frombuffer(raw, "<i8", docs, at)
        names = np.frombuffer(raw, "<i8", docs, at + 8 * docs)
        known = np.frombuffer(raw, np.uint8, docs, at + 16 * docs)
        at += 17 * docs
        blocks.append(
            {"offset": offset, "length": length, "ids": ids, "sizes": sizes, "names": names, "known": known}
        )
    return blocks


class _File:
    """One file of coded blocks in the making."""

    def __init__(self, folder: str):
        self.name = f"{uuid.uuid4().hex}.ids"
        self.table, _ = load_table(folder)
        system, path = _open(folder)
        self.out = system.open_output_stream(f"{path}/{self.name}")
        self.out.write(FILE_MAGIC)
        self.place, self.total, self.blocks = len(FILE_MAGIC), 0, []
        self.waiting: list[tuple[int | None, np.ndarray]] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.waiting.append((doc_id, ids))
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            ids = np.concatenate([i for _, i in self.waiting])
            raw = rans.encode(ids, self.table)
            self.out.write(raw)
            self.blocks.append(
                {
                    "offset": self.place,
                    "length": len(raw),
                    "ids": len(ids),
                    "sizes": [len(i) for _, i in self.waiting],
                    "docs": [d for d, _ in self.waiting],
                }
            )
            self.place += len(raw)
            self.total += len(ids)
            self.waiting, self.held = [], 0

    def close(self) -> None:
        self.flush()
        index = _index_bytes(self.blocks)
        self.out.write(index)
        self.out.write(struct.pack(TAIL, self.place, len(index), zlib.crc32(index), FILE_MAGIC))
        self.out.close()


def _write(folder: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for batch in batches:
            for doc_id, raw in zip(
                batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True
            ):
                file = file or _File(folder)
                file.add(doc_id, np.frombuffer(raw, kind))
        if file:
            file.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([file.name]), pa.array([file.total], pa.int64())],
                names=["file", "file_ids"],
            )

    return run


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Code all ``docs (doc_id, text)`` into files in ``folder``.

    Returns the manifest: ``part`` (order of the files), ``file``, ``file_ids`` and ``first`` (ids
    in earlier files). Files of tasks that did not finish are not in it. Documents follow in
    ascending doc_id, null first, repeated ids in any order; a null text is the end id alone.
    """
    size = max(tokens.encoder(path).size, end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.mapInArrow(_encoded(path, end_id, kind), "doc_id long, ids binary")
    # Numbers make repeated doc_ids divisible between files.
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "ids")
    counted = found.select("ids").mapInArrow(_counts(kind, size), "id long, n long")
    # One row for each id of the vocabulary at most.
    totals = counted.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[totals["id"].to_numpy(int)] = totals["n"].to_numpy(int)
    save_table(counts, folder)
    parts = max(6, -(-int(counts.sum()) // (64 * BLOCK_IDS)))
    ordered = found.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    files = ordered.select("doc_id", "ids").mapInArrow(
        _write(folder, kind), "file string, file_ids long"
    )
    manifest = written(files.withColumn("part", F.spark_partition_id()), "manifest")
    # One row for each file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written(
        manifest.withColumn("first", F.coalesce(F.sum("file_ids").over(before), F.lit(0))), "files"
    )


def _blocks(folder: str):
    """Checkpoints of each file: one row per block with its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(
                batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True
            ):
                system, path = _open(folder)
                with system.open_input_file(f"{path}/{name}") as file:
                    size = file.size()
                    file.seek(size - TAIL_SIZE)
                    place, length, crc, magic = struct.unpack(TAIL, file.read(TAIL_SIZE))
                    file.seek(place)
                    raw = file.read(length)
                if magic != FILE_MAGIC or zlib.crc32(raw) != crc:
                    raise rans.BadBlock(f"the index of {name} is damaged")
                rows = []
                for b in _index_blocks(raw):
                    names = [
                        int(d) if k else None for d, k in zip(b["names"], b["known"], strict=True)
                    ]
                    rows.append((name, b["offset"], b["length"], first, b["sizes"].tolist(), names))
                    first += b["ids"]
                kinds = [
                    pa.string(), pa.int64(), pa.int64(), pa.int64(),
                    pa.list_(pa.int64()), pa.list_(pa.int64()),
                ]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                    names=["file", "offset", "length", "start", "sizes", "docs"],
                )

    return run


BLOCK = "file string, offset long, length long, start long, sizes array<long>, docs array<long>"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _decoded(folder: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, slots = load_table(folder)
        system, path = _open(folder)
        for batch in batches:
            for block in batch.to_pylist():
                with system.open_input_file(f"{path}/{block['file']}") as file:
                    file.seek(block["offset"])
                    ids = rans.decode(file.read(block["length"]), table, slots)
                sizes = np.array(block["sizes"], np.int64)
                starts = np.cumsum(sizes) - sizes
                own = [ids[s : s + n] for s, n in zip(starts, sizes, strict=True)]
                kept = [i.tobytes() if with_ids else None for i in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block["docs"], pa.int64()),
                        pa.array(starts + block["start"]),
                        pa.array(sizes),
                        pa.array([tokens.crc(i) for i in own], pa.int64()),
                        pa.array(kept, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return run


def read(files: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents of all ``files (file, first)`` with place, number of ids, checksum and ids.

    ``ids`` are little-endian unsigned 32-bit integers. Blocks are spread over all tasks.
    """
    blocks = written(files.select("file", "first").mapInArrow(_blocks(folder), BLOCK), "blocks")
    # A number of its own keeps the few, small rows from being put into one task.
    tasks = max(1, -(-blocks.count() // BLOCKS_PER_TASK))
    dealt = blocks.repartition(tasks, F.xxhash64("file", "offset"))
    return dealt.mapInArrow(_decoded(folder, with_ids), DOCUMENT)


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as found in the files that were written."""
    folder = new_folder(spark, "ids")
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    files = write(
        read_table(spark, sf_dir, "documents"), folder, tokens.vocabulary("byte_bpe_50k.json")
    )
    return read(files, folder, with_ids=False).drop("ids")
