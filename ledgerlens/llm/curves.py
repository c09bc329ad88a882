"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected on a few random directions, cut into cells (shifted anew for each curve) and
ordered along a Hilbert curve. Each of several such orders is range-partitioned by Spark and cut
into blocks of consecutive rows; a query looks at its own block and its neighbours on every curve. Within a
cell each curve orders by a direction of its own, so that a cluster in one cell is not cut alike by
all curves. Windows compare the vectors in double precision and keep as many partners as an answer
holds, so a window loses none of the nearest it sees; partners merge and are ranked by cosine.

Vectors of one direction are one entry of the index, with as many of their smallest ids as an
answer can hold, so a vector that a third of all rows share is no hot spot.

On vectors without cluster structure near neighbours are hardly nearer than others, and windows
must cover a fixed share of all rows to find nine of ten; that share is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import read_table, written
from ledgerlens.llm.vectors import packed, stacked, usable

K, EVERY = 5, 50
CURVES, AXES, BITS = 24, 12, 3
BLOCK = 512
"""Consecutive entries of a curve that are compared in one task."""
SHARE = 0.02
"""Share of all entries that a query looks at on each side of it, on every curve."""
SAMPLE = 2_000
"""Vectors that the cell borders are fitted on; every vector is indexed."""


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of integer cells on the Hilbert curve (Skilling's transform), as int64."""
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= np.where(high & (i == 0), 0, swap)
        q >>= 1
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[:, axes - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


@dataclass
class Curves:
    """Directions and cell borders of every curve, for vectors of one length."""

    directions: np.ndarray
    borders: np.ndarray
    within: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, curves: int = CURVES) -> Curves:
        """Borders are quantiles of the sample, moved by a random part of a cell."""
        rng = np.random.default_rng(sample.shape[1])
        directions = rng.normal(size=(curves, sample.shape[1], AXES))
        cells = 1 << BITS
        borders = np.empty((curves, AXES, cells - 1))
        for c in range(curves):
            along = sample @ directions[c]
            for a in range(AXES):
                at = (np.arange(1, cells) + rng.uniform(-0.5, 0.5)) / cells
                borders[c, a] = np.quantile(along[:, a], at)
        return cls(directions, borders, rng.normal(size=(curves, sample.shape[1])))

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        along = vectors @ self.directions[curve]
        cells = np.stack(
            [np.searchsorted(self.borders[curve, a], along[:, a]) for a in range(AXES)], axis=1
        )
        return hilbert(cells, BITS)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first so that squares neither vanish nor overflow."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors divided by their largest component: the same doubles for all that are parallel."""
    return vectors / np.abs(vectors).max(axis=1, keepdims=True) + 0.0


def originals(codes, size: int) -> np.ndarray:
    """Vectors that are stored as bytes of floats or doubles."""
    rows = [np.frombuffer(c, np.float32 if len(c) == 4 * size else np.float64) for c in codes]
    return np.array(rows, np.float64).reshape(len(rows), size)


def decoded(codes, size: int) -> np.ndarray:
    """Directions of vectors that are stored as bytes of floats or doubles."""
    return directions(originals(codes, size))


def _directed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Direction of each vector, and its bytes as floats where those hold it exactly."""
    for batch in batches:
        vectors = packed(batch.column("vector"))
        ways, codes = [], []
        for v in map(np.frombuffer, vectors):
            with np.errstate(over="ignore", under="ignore"):
                short = v.astype(np.float32)
            ways.append(directions(v[None])[0].tobytes())
            codes.append((short if (short == v).all() else v).tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id"),
                batch.column("asks"),
                pa.array([len(v) // 8 for v in vectors], pa.int32()),
                pa.array(ways, pa.binary()),
                pa.array(codes, pa.binary()),
            ],
            names=["vec_id", "asks", "size", "direction", "code"],
        )


DIRECTED = "vec_id long, asks boolean, size int, direction binary, code binary"


def _entries(fitted: dict[int, Curves]):
    """One row per entry and curve: its cell, and its place within the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                some = batch.filter(pa.array(sizes == size))
                vectors = unit(decoded(some.column("code").to_pylist(), size))
                own = fitted[size]
                for curve in range(len(own.directions)):
                    n = len(vectors)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, curve, np.int32)),
                            some.column("size"),
                            pa.array(own.keys(vectors, curve)),
                            pa.array(vectors @ own.within[curve]),
                            some.column("entry"),
                            some.column("asks"),
                        ],
                        names=["curve", "size", "key", "within", "entry", "asks"],
                    )

    return run


ENTRY = "curve int, size int, key long, within double, entry long, asks boolean"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a sorted partition and cut each curve into chunks of BLOCK rows."""
    counts: dict[tuple[int, int], int] = {}
    for batch in batches:
        curves, sizes = batch.column("curve").to_numpy(), batch.column("size").to_numpy()
        chunk = np.zeros(len(curves), np.int64)
        for curve, size in set(zip(curves.tolist(), sizes.tolist(), strict=True)):
            mine = np.flatnonzero((curves == curve) & (sizes == size))
            seen = counts.get((curve, size), 0)
            chunk[mine] = (seen + np.arange(len(mine))) // BLOCK
            counts[curve, size] = seen + len(mine)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(chunk)], names=[*batch.schema.names, "chunk"]
        )


def _window(keep: int):
    """Best partners of each query among the rows of one block, its own entry aside."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        rows, asked = cell[~cell["visits"]], cell[cell["visits"]]
        found_q, found_r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(rows) and len(asked):
            size = int(cell["size"].iloc[0])
            left, right = decoded(asked["code"], size), decoded(rows["code"], size)
            near = unit(left) @ unit(right).T
            ids, queries = rows["entry"].to_numpy(), asked["entry"].to_numpy()
            near[queries[:, None] == ids] = -np.inf
            # What rounding may move across the last place is compared by the final score.
            slack = 8 * size * np.finfo(np.float64).eps
            for q, scores in enumerate(near):
                picked = np.flatnonzero(scores > -np.inf)
                if len(picked) > keep:
                    last = np.partition(scores, len(scores) - keep)[len(scores) - keep]
                    picked = np.flatnonzero(scores >= last - slack)
                if len(picked) > keep:
                    exact = np.array([cosine(left[q], right[r]) for r in picked])
                    picked = picked[np.lexsort((ids[picked], -exact))[:keep]]
                found_q.append(np.full(len(picked), queries[q]))
                found_r.append(ids[picked])
        return pd.DataFrame({"asking": np.concatenate(found_q), "entry": np.concatenate(found_r)})

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("left", "right", "size"))
        score = [
            cosine(*(originals([x], size)[0] for x in (a, b)))
            for a, b, size in zip(*columns, strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("asking"), batch.column("entry"), pa.array(score, pa.float64())],
            names=["asking", "entry", "score"],
        )


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine in double precision; very large or small vectors are scaled by a power of two."""
    a, b = (v * 2.0 ** -np.frexp(np.abs(v).max())[1] for v in (a, b))
    return float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))


def nearest(embeddings: DataFrame, k: int = K, every: int = EVERY, share: float = SHARE):
    """``query_id, rank, vec_id, score``: the k nearest found for each query, by cosine.

    Queries are the vectors whose vec_id is divisible by ``every``; a query is not its own
    candidate; ties go to the smaller vec_id. Zero vectors take no part; vectors of different
    lengths never meet. See ``usable`` for other rows that take no part and for repeated ids.
    """
    rows = usable(embeddings).filter(F.exists("vector", lambda x: x != 0))
    rows = rows.withColumn("asks", F.col("vec_id") % every == 0)
    rows = written(rows.mapInArrow(_directed, DIRECTED), "vectors")
    # The k + 1 smallest ids of one direction; Spark cuts each group before it is shuffled.
    order = Window.partitionBy("direction").orderBy("vec_id")
    low = rows.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= k + 1)
    members = low.groupBy("direction").agg(
        F.array_sort(F.collect_list("vec_id")).alias("ids"),
        F.min_by("code", "vec_id").alias("code"),
        F.first("size").alias("size"),
    )
    asked = rows.filter("asks").select("direction", F.lit(True).alias("asks")).distinct()
    entries = members.join(asked, "direction", "left").select(
        F.element_at("ids", 1).alias("entry"),
        "ids",
        "direction",
        "code",
        "size",
        F.coalesce("asks", F.lit(False)).alias("asks"),
    )
    entries = written(entries, "entries")
    sizes = {r["size"]: r["count"] for r in entries.groupBy("size").count().collect()}
    fitted = {}
    for size in sizes:
        some = entries.filter(F.col("size") == size).orderBy(F.xxhash64("entry")).limit(SAMPLE)
        fitted[size] = Curves.fit(unit(stacked(r["direction"] for r in some.select("direction").collect())))
    asking = entries.select("entry", "size", "code", "asks")
    keyed = written(asking.mapInArrow(_entries(fitted), ENTRY), "keys")
    parts = max(8, -(-sum(sizes.values()) * CURVES // (128 * BLOCK)))
    sorted_rows = keyed.repartitionByRange(parts, "curve", "size", "key", "within", "entry")
    sorted_rows = sorted_rows.sortWithinPartitions("curve", "size", "key", "within", "entry")
    cut = sorted_rows.mapInArrow(_chunks, f"{ENTRY}, chunk long")
    cut = written(cut.withColumn("part", F.spark_partition_id()), "chunks")
    # Blocks of a curve are numbered through: one small row for each partition and curve.
    own = Window.partitionBy("curve", "size").orderBy("part")
    starts = cut.groupBy("curve", "size", "part").agg((F.max("chunk") + 1).alias("chunks"))
    starts = starts.withColumn(
        "first", F.sum("chunks").over(own) - F.col("chunks")
    ).drop("chunks")
    blocks = cut.join(starts, ["curve", "size", "part"]).withColumn(
        "block", F.col("first") + F.col("chunk")
    )
    reach = {size: max(1, round(share * n / BLOCK)) for size, n in sizes.items()}
    wide = F.element_at(
        F.create_map(*[F.lit(x) for pair in reach.items() for x in pair]), F.col("size")
    )
    around = F.sequence(F.col("block") - wide, F.col("block") + wide)
    # A row stands in its own block, and a query also visits the blocks around it.
    here = F.array(F.struct(F.col("block"), F.lit(False).alias("visits")))
    visited = F.transform(around, lambda b: F.struct(b.alias("block"), F.lit(True).alias("visits")))
    places = F.when(F.col("asks"), F.concat(here, visited)).otherwise(here)
    cells = blocks.join(entries.select("entry", "code"), "entry").select(
        "curve", "size", "entry", "code", F.explode(places).alias("place")
    ).select("curve", "size", "place.block", "entry", "code", "place.visits")
    pairs = cells.groupBy("curve", "size", "block").applyInPandas(
        _window(k), "asking long, entry long"
    )
    # Other ids of a query's own entry are its nearest, and no window has to find them.
    same = entries.filter("asks").select(F.col("entry").alias("asking"), "entry")
    left = entries.select(F.col("entry").alias("asking"), F.col("code").alias("left"))
    right = entries.select("entry", "size", F.col("code").alias("right"))
    scored = pairs.distinct().union(same).join(left, "asking").join(right, "entry").select(
        "asking", "entry", "size", "left", "right"
    ).mapInArrow(_cosines, "asking long, entry long, score double")
    # Every entry stands for its smallest ids; k + 1 of them hold the answer of each query.
    listed = scored.join(entries.select("entry", "ids"), "entry").select(
        "asking", "score", F.explode("ids").alias("vec_id")
    )
    best = Window.partitionBy("asking").orderBy(F.col("score").desc(), "vec_id")
    listed = written(
        listed.withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= k + 1), "found"
    )
    lists = listed.groupBy("asking").agg(
        F.array_sort(F.collect_list(F.struct("turn", "vec_id", "score"))).alias("found")
    )
    ways = entries.select(F.col("entry").alias("asking"), "direction")
    lists = lists.join(ways, "asking").select("direction", "found")
    asking = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "direction")
    # All that the entries list is scored once more, each id with its own vector.
    answers = asking.join(written(lists, "answers"), "direction").select(
        F.col("query_id").alias("asking"), F.explode("found.vec_id").alias("entry")
    ).filter("asking <> entry")
    own = rows.select("vec_id", "code", "size")
    left = own.select(F.col("vec_id").alias("asking"), F.col("code").alias("left"))
    right = own.select(F.col("vec_id").alias("entry"), "size", F.col("code").alias("right"))
    answers = answers.join(left, "asking").join(right, "entry").select(
        "asking", "entry", "size", "left", "right"
    ).mapInArrow(_cosines, "asking long, entry long, score double")
    best = Window.partitionBy("asking").orderBy(F.col("score").desc(), "entry")
    answers = answers.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return answers.select(
        F.col("asking").alias("query_id"), "rank", F.col("entry").alias("vec_id"), "score"
    )


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every fiftieth vector."""
    return nearest(read_table(spark, sf_dir, "embeddings"))
