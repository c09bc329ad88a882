"""Cost-balanced packing of token sequences.

A document of more tokens than a sequence holds is cut into full pieces and a rest. Pieces are
dealt to shards; in a shard, pieces in descending order go to the sequence of the lowest estimated
attention cost (linear in its tokens plus quadratic in each piece) that still has room. A shard
opens as many sequences as its tokens need and another one only when nothing has room.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import tokens
from ledgerlens.llm.common import read_table, written

LENGTH = 4096
END_ID = 2
SHARD_TOKENS = 1 << 23
"""Tokens that one task packs."""
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
"""Cost of a token, and of a pair of tokens that attend to each other."""

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces_of(path: str, end_id: int = END_ID, length: int = LENGTH):
    """Arrow batches of ``doc_id, text`` to pieces of at most ``length`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECE.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            found = tokens.encode_all(path, texts, end_id)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                for start in range(0, len(ids), length):
                    part = ids[start : start + length]
                    rows.append((doc_id, start, len(part), tokens.crc(part), len(ids)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in columns], names=names
            )

    return run


def assign(lengths: np.ndarray, room: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces come in descending order of length."""
    count = max(1, -(-int(lengths.sum()) // room))
    cost, left = np.zeros(count), np.full(count, room)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths):
        at = int(np.where(left >= n, cost, np.inf).argmin())
        if left[at] < n:
            at = len(cost)
            cost, left = np.append(cost, 0.0), np.append(left, room)
        sequence[i], offset[i] = at, room - left[at]
        left[at] -= n
        cost[at] += LINEAR * n + QUADRATIC * n * n
    return sequence, offset


def _pack(room: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "piece"], ascending=[False, True])
        sequence, offset = assign(shard["length"].to_numpy(), room)
        fill = np.bincount(sequence, shard["length"])[sequence].astype(np.int64)
        whole = (fill & (fill - 1)) == 0
        return shard.assign(
            sequence_id=(shard["shard"].to_numpy() << 32) + sequence,
            offset=offset,
            # A power of two needs no padding; all else is padded to the full length.
            padded_length=np.where(whole, fill, room),
        ).drop(columns=["piece", "shard"])

    return run


def pack(docs: DataFrame, path: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents with their place: ``sequence_id``, ``offset``, ``padded_length``.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur; a
    null doc_id stays null. Other columns of ``docs`` are not looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.mapInArrow(pieces_of(path, end_id, length), PIECE)
    found = written(found.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    total = found.agg(F.sum("length")).head()[0] or 0
    shards = max(1, -(-total // SHARD_TOKENS))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards)))
    schema = f"{PIECE}, sequence_id long, offset long, padded_length long"
    return dealt.groupBy("shard").applyInPandas(_pack(length), schema)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of the documents that are left."""
    return pack(docs, tokens.vocabulary("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 tokens."""
    return packed(spark, read_table(spark, sf_dir, "documents"), sf_dir)
