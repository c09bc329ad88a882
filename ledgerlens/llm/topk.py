"""Exact top-k search by segment statistics, coarse to fine.

A vector is cut into segments; of each segment the mean and the deviation are kept. For segments
of length L the squared distance of two vectors is at least the sum of
L ((mean - mean')^2 + (deviation - deviation')^2), so with known norms their inner product is at
most the sum of L (mean mean' + deviation deviation'). A candidate whose bound lies below a
query's k-th best score so far is dropped; the others meet the next finer segments, and exact
scores are computed only for those left, most promising first.

Candidates and queries are cut into blocks, and each task compares one block of each: nothing
grows with the input but the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import read_table, written
from ledgerlens.llm.vectors import packed, stacked, usable

SCALE = 256
SAFE = float(1 << 62)
"""Where a product of norms stays below this, no sum of products leaves 64 bits."""
K, EVERY = 5, 50
SEGMENTS = (16, 4, 2)
"""Segment lengths, coarse to fine."""
CANDIDATES, QUERIES = 8192, 4096
"""Rows of a block of candidates and of a block of queries."""
FIRST, STEP = 64, 256
"""Candidates scored exactly before any bound is used, and at a time after that."""
SLACK = 1e-9
"""Relative room for rounding in the bounds."""


def statistics(vectors: np.ndarray, length: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that a dot product is the bound."""
    n, d = vectors.shape
    starts = np.arange(0, d, length)
    counts = np.diff(np.append(starts, d))
    mean = np.add.reduceat(vectors, starts, axis=1) / counts
    square = np.add.reduceat(vectors * vectors, starts, axis=1) / counts
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.hstack([mean, deviation]) * np.sqrt(np.hstack([counts, counts]))


def whole(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as integers that hold every inner product: 64 bits where these do, else Python's."""
    norms = [
        np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max(initial=0) for m in (queries, rows)
    ]
    if norms[0] * norms[1] < SAFE and max(norms) < SAFE:
        return queries.astype(np.int64), rows.astype(np.int64)
    return tuple(
        np.array([int(x) for x in m.ravel().tolist()], object).reshape(m.shape)
        for m in (queries, rows)
    )


def search(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int
) -> tuple[list[tuple[int, int, int]], int]:
    """``(query_id, vec_id, score)`` of the k best rows of each query, and how many were scored."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    exact_q, exact_r = whole(queries, rows)
    levels = [
        (statistics(queries.astype(np.float64), n), statistics(rows.astype(np.float64), n))
        for n in SEGMENTS
    ]
    norm_q = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    norm_r = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)
    found: list[tuple[int, int, int]] = []
    scored = 0
    for i, own in enumerate(query_ids.tolist()):
        room = SLACK * (norm_q[i] * norm_r + 1)
        others = np.flatnonzero(ids != own)
        best = others[:FIRST]
        score = exact_r[best] @ exact_q[i]
        left = others[FIRST:]

        def cut(best, score):
            # Sorted by id first, so that a stable sort leaves ties to the smaller id.
            keep = np.argsort(ids[best], kind="stable")
            keep = keep[np.argsort(-score[keep], kind="stable")][:k]
            return best[keep], score[keep]

        scored += len(best)
        best, score = cut(best, score)
        bound = np.zeros(0)
        for stats_q, stats_r in levels:
            if not len(left):
                break
            bound = stats_r[left] @ stats_q[i] + room
            good = bound >= (float(score[-1]) if len(score) == k else -np.inf)
            left, bound = left[good], bound[good]
        left = left[np.argsort(-bound, kind="stable")] if len(left) else left
        bound = np.sort(bound)[::-1]
        for at in range(0, len(left), STEP):
            if len(score) == k and bound[at] < float(score[-1]):
                break
            some = left[at : at + STEP]
            scored += len(some)
            best, score = cut(
                np.append(best, some), np.append(score, exact_r[some] @ exact_q[i])
            )
        found += [(own, int(v), fitting(s)) for v, s in zip(ids[best], score, strict=True)]
    return found, scored


def fitting(score: int) -> int:
    """``score``, if the column of 64 bits can hold it."""
    if not -(1 << 63) <= score < 1 << 63:
        raise OverflowError(f"the inner product {score} does not fit in 64 bits")
    return int(score)


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scaled integers as bytes of doubles, or of 32 bits where these hold them."""
    for batch in batches:
        sizes, values = [], []
        for raw in packed(batch.column("vector")):
            with np.errstate(over="ignore"):
                scaled = np.floor(SCALE * np.frombuffer(raw))
            if not np.isfinite(scaled).all():
                raise OverflowError("a scaled component leaves the range of doubles")
            small = np.abs(scaled).max() < 1 << 31
            sizes.append(len(scaled))
            values.append(scaled.astype(np.int32 if small else np.float64).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(sizes, pa.int32()), pa.array(values, pa.binary())],
            names=["vec_id", "size", "value"],
        )


def _matrix(values: pd.Series, size: int) -> np.ndarray:
    """Rows of scaled integers; all are doubles where one of them is."""
    if all(len(v) == 4 * size for v in values):
        return stacked(values, np.int32)
    kinds = (np.int32 if len(v) == 4 * size else np.float64 for v in values)
    return np.array([np.frombuffer(v, k).astype(np.float64) for v, k in zip(values, kinds)])


def _compare(k: int):
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        asked, rows, size = cell[cell["asks"]], cell[~cell["asks"]], int(cell["size"].iloc[0])
        found: list = []
        if len(asked) and len(rows):
            found, _ = search(
                _matrix(asked["value"], size), asked["vec_id"].to_numpy(),
                _matrix(rows["value"], size), rows["vec_id"].to_numpy(), k,
            )
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest integer inner products of each query.

    Queries are the vectors whose vec_id is divisible by ``every``; a query is not its own
    candidate; ties go to the smaller vec_id. Vectors of different lengths never meet. Components
    of any size take part: large products are summed in Python integers, and a score among the
    best that 64 bits cannot hold is an error, as is a component that leaves the range of doubles
    when scaled. See ``usable`` for rows that take no part and for repeated ids.
    """
    rows = usable(embeddings).mapInArrow(_scaled, "vec_id long, size int, value binary")
    rows = written(rows, "integers")
    asks = F.col("vec_id") % every == 0
    count = rows.agg(F.count("*"), F.count(F.when(asks, 1))).head()
    blocks, parts = max(1, -(-count[0] // CANDIDATES)), max(1, -(-count[1] // QUERIES))
    hashed = F.xxhash64("vec_id")
    candidates = rows.withColumns(
        {
            "block": F.pmod(hashed, F.lit(blocks)),
            "part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))),
            "asks": F.lit(False),
        }
    )
    queries = rows.filter(asks).withColumns(
        {
            "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))),
            "part": F.pmod(hashed, F.lit(parts)),
            "asks": F.lit(True),
        }
    )
    cells = candidates.unionByName(queries).groupBy("size", "block", "part")
    found = cells.applyInPandas(_compare(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector."""
    return top_k(read_table(spark, sf_dir, "embeddings"))


SQL = """
WITH clean AS (
    SELECT vec_id, max(embedding::DOUBLE[]) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    GROUP BY vec_id),
scaled AS (
    SELECT vec_id, list_transform(x, lambda e: floor(256 * e)) AS v, len(x) AS n FROM clean),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM scaled q JOIN scaled c ON q.n = c.n AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r,
        vec_id, score FROM scores)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
