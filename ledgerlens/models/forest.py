"""Random forests grown level by level from counts over binned rows.

The rules are those of ``RandomForestClassifier``: Poisson bootstrap, a random subset of the features
per node, weighted Gini gain over at most ``BINS`` bins, sibling leaves of one class merged. What
differs is the work per row. Every task counts its rows with numpy, a whole block per step, and keeps
nothing per row and tree: bootstrap counts are drawn again from the row's own seed in every level.
Counts are whole numbers and draws follow from the row alone, so neither the partitions of the
training rows nor their order change a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.quantiles import many_quantiles
from ledgerlens.sources.scratch import new_folder, written
from ledgerlens.sources.ship import ship

BINS = 32
# Distinct values of a feature are counted up to here before its quantiles are taken.
FEW = 2 * BINS

BLOCK = "n int, seeds binary, labels binary, bins binary"
COUNTS = "tree int, counts binary"
SPLITS = (
    "tree int, node int, feature int, bin int, gain double, counts array<bigint>, below array<bigint>"
)
# Bytes of counts a task may hold; where a level needs more, its trees are counted in several passes.
PASS_BYTES = 64 << 20
# Trees that share 64 random bits per row.
SHARED = 4


def row_seed(draw_key: Column) -> Column:
    """60 bits of the draw key's far end; its first digits decide the split and are not uniform."""
    return F.conv(F.substring(draw_key, 18, 15), 16, 10).cast("bigint")


def thresholds(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """At most ``BINS - 1`` ascending thresholds per column: between all values if these are few,
    else the quantiles of all rows. A value goes left if it is at most the threshold.
    """
    values = [F.col(c).cast("double").alias(c) for c in columns]
    distinct = rows.agg(F.array(*(F.approx_count_distinct(v) for v in values))).first()[0]
    result: dict[str, list[float]] = {}
    few = [c for c, n in zip(columns, distinct) if n <= FEW]
    if few:
        # About ``FEW`` values a column.
        sets = rows.select(values).agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in few)).first()
        for c in few:
            if len(sets[c]) <= BINS:
                result[c] = [(a + b) / 2 for a, b in zip(sets[c], sets[c][1:])]
    rest = [c for c in columns if c not in result]
    if rest:
        found = many_quantiles(rows, rest, [i / BINS for i in range(1, BINS)])
        result |= {c: np.unique(found[c]).tolist() for c in rest}
    return [result[c] for c in columns]


def binned(
    train: DataFrame, columns: list[str], label: str, edges: list[list[float]], parts: int
) -> DataFrame:
    """Training rows as blocks of seeds, labels and one byte per feature, column after column."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema]
        for batch in batches:
            if not batch.num_rows:
                continue
            seeds, labels, *values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            bins = np.stack([np.searchsorted(e, v) for e, v in zip(edges, values)])
            row = (
                batch.num_rows, seeds.astype("<u8").tobytes(),
                labels.astype("u1").tobytes(), bins.astype("u1").tobytes(),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip(row, schema)], names
            )

    schema = pa.schema(
        [("n", pa.int32()), ("seeds", pa.binary()), ("labels", pa.binary()), ("bins", pa.binary())]
    )
    rows = train.select(
        row_seed(F.col("draw_key")).alias("seed"),
        F.col(label).cast("int").alias("label"),
        *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)),
    )
    return rows.repartition(parts).mapInArrow(blocks, BLOCK)


def poisson_table() -> np.ndarray:
    """Poisson(1) counts by a uniform number of 16 bits."""
    chances = np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)])
    return np.searchsorted(np.cumsum(chances), (np.arange(65536) + 0.5) / 65536).astype(np.float64)


def mixed(seeds: np.ndarray, salt: int) -> np.ndarray:
    """Pseudo-random 64 bits per seed (the finalizer of SplitMix64)."""
    z = seeds + np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def counter(
    feature: np.ndarray, cut: np.ndarray, group: range, level: int, n_features: int, classes: int,
    seed: int,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task that counts its rows per tree of the group, feature, node of the level, class and bin.

    ``feature`` and ``cut`` hold the split of every node above the level; rows in a leaf go on to
    the left, to nodes that are not looked at.
    """
    size = (1 << level) * classes * BINS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = poisson_table()
        total = np.zeros((len(group), n_features, size))
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                seeds = np.frombuffer(row["seeds"], "<u8")
                labels = np.frombuffer(row["labels"], "u1").astype(np.intp) * BINS
                flat = np.frombuffer(row["bins"], "u1")
                bins = flat.reshape(n_features, n).astype(np.intp)
                place = np.arange(n, dtype=np.intp)
                starts = np.arange(n_features, dtype=np.intp) * n
                for counts, tree in zip(total, group):
                    if tree % SHARED == 0:
                        bits = mixed(seeds, seed + tree // SHARED).view("<u2").reshape(n, SHARED)
                    times = draws.take(bits[:, tree % SHARED])
                    node = np.zeros(n, np.intp)
                    for above in range(level):
                        first, end = (1 << above) - 1, (2 << above) - 1
                        at = starts[feature[tree, first:end]].take(node)
                        at += place
                        right = flat.take(at) > cut[tree, first:end].take(node)
                        node <<= 1
                        node += right
                    node *= classes * BINS
                    node += labels
                    for f in range(n_features):
                        counts[f] += np.bincount(node + bins[f], times, size)
        if total.any():
            parts = [np.rint(t).astype("<i8").tobytes() for t in total]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group, pa.int32()), pa.array(parts, pa.binary())],
                ["tree", "counts"],
            )

    return count


def chooser(
    level: int, n_features: int, classes: int, weights: list[float], per_node: int, seed: int
) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Task that adds up the counts of one tree and finds the best split of every node."""

    def choose(parts: pd.DataFrame) -> pd.DataFrame:
        tree = int(parts["tree"].iloc[0])
        total = sum(np.frombuffer(p, "<i8") for p in parts["counts"])
        total = total.reshape(n_features, 1 << level, classes, BINS)
        rows = []
        for node in range(1 << level):
            counts = total[0, node].sum(axis=1)
            draw = np.random.default_rng([seed, tree, level, node])
            some = np.sort(draw.permutation(n_features)[:per_node])
            feature, cut, gain, below = best_split(total[some, node], weights)
            feature = int(some[feature]) if gain > 0 else -1
            rows.append((tree, node, feature, cut, gain, counts.tolist(), below.tolist()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SPLITS.split(", ")])

    return choose


def impurity(weighted: np.ndarray) -> np.ndarray:
    """Gini impurity over the last axis; 0 for nothing."""
    whole = weighted.sum(axis=-1, keepdims=True)
    return 1 - np.sum((weighted / np.where(whole > 0, whole, 1)) ** 2, axis=-1) - (whole[..., 0] <= 0)


def best_split(counts: np.ndarray, weights: list[float]) -> tuple[int, int, float, np.ndarray]:
    """(feature, bin, gain, counts below) of ``counts[feature, class, bin]``; no gain is 0."""
    below = np.moveaxis(counts.cumsum(axis=2), 1, 2)[:, :-1]
    whole = counts[0].sum(axis=1)
    left, right = below * np.array(weights), (whole - below) * np.array(weights)
    all_weight = float((whole * weights).sum()) or 1.0
    gain = (
        impurity(whole * np.array(weights))
        - left.sum(axis=2) / all_weight * impurity(left)
        - right.sum(axis=2) / all_weight * impurity(right)
    )
    gain[(below.sum(axis=2) == 0) | ((whole - below).sum(axis=2) == 0)] = 0
    feature, cut = np.unravel_index(np.argmax(gain), gain.shape)
    return int(feature), int(cut), max(0.0, float(gain[feature, cut])), below[feature, cut]


def node_rows(
    splits: dict[tuple[int, int], tuple], tree: int, edges: list[list[float]], weights: list[float]
) -> list[tuple]:
    """One tree in the form a saved forest has: nodes from the root on, left before right.

    Sibling leaves of the same class become one leaf, as Spark's own forests have it.
    """

    def grown(at: int, level: int, counts: np.ndarray) -> list:
        split = splits.get((tree, at))
        if split is None or np.count_nonzero(counts) < 2:
            return [counts]
        feature, cut, gain, below = split
        left = grown(2 * at + 1, level + 1, below)
        right = grown(2 * at + 2, level + 1, counts - below)
        if len(left) == len(right) == 1 and decided(left[0]) == decided(right[0]):
            return [counts]
        return [counts, feature, cut, gain, left, right]

    def decided(counts: np.ndarray) -> int:
        return int(np.argmax(counts * np.array(weights)))

    def flat(node: list, number: int, out: list) -> int:
        """Append the node and what is below it; the next free number."""
        counts = node[0]
        stats = counts * np.array(weights)
        about = (float(decided(counts)), float(impurity(stats)), stats.tolist(), int(counts.sum()))
        if len(node) == 1:
            out.append((tree, (number, *about, -1.0, -1, -1, (-1, [], -1))))
            return number + 1
        _, feature, cut, gain, left, right = node
        place = len(out)
        out.append(None)
        second = flat(left, number + 1, out)
        end = flat(right, second, out)
        threshold = (feature, [float(edges[feature][cut])], -1)
        out[place] = (tree, (number, *about, float(gain), number + 1, second, threshold))
        return end

    out: list = []
    flat(grown(0, 0, splits[tree, -1]), 0, out)
    return out


def fit(
    train: DataFrame, columns: list[str], label: str, weights: list[float],
    trees: int, depth: int, seed: int, parts: int,
) -> RandomForestClassificationModel:
    """A forest on ``columns``; ``weights`` has the weight of every class, ``draw_key`` tells rows apart.

    ``parts`` tasks put the rows into blocks.
    """
    ship(train.sparkSession)
    classes, n_features = len(weights), len(columns)
    per_node = int(np.ceil(np.sqrt(n_features)))
    edges = thresholds(train, columns)
    blocks = written(binned(train, columns, label, edges, parts), "bins")
    feature = np.zeros((trees, (1 << depth) - 1), np.int32)
    cut = np.full((trees, (1 << depth) - 1), 255, np.uint8)
    splits: dict[tuple[int, int], tuple] = {}
    for level in range(depth):
        each = 8 * n_features * (1 << level) * classes * BINS
        step = max(SHARED, PASS_BYTES // each // SHARED * SHARED)
        chosen = []
        for first in range(0, trees, step):
            group = range(first, min(trees, first + step))
            counted = blocks.mapInArrow(
                counter(feature, cut, group, level, n_features, classes, seed), COUNTS
            ).groupBy("tree")
            choose = chooser(level, n_features, classes, weights, per_node, seed)
            # One row per node of the level.
            chosen += counted.applyInPandas(choose, SPLITS).collect()
        for r in chosen:
            at = (1 << level) - 1 + r.node
            if not level:
                splits[r.tree, -1] = np.array(r.counts)
            alive = not level or (r.tree, (at - 1) // 2) in splits
            if alive and r.feature >= 0:
                splits[r.tree, at] = (r.feature, r.bin, r.gain, np.array(r.below))
                feature[r.tree, at], cut[r.tree, at] = r.feature, r.bin
    # A tree that drew no row at all has no counts; only tables of a few rows have such trees.
    nothing = np.zeros(classes, np.int64)
    nodes = [
        row for tree in range(trees)
        for row in node_rows(splits if (tree, -1) in splits else {(tree, -1): nothing}, tree, edges, weights)
    ]
    return assembled(train, nodes, n_features, classes, label, trees, depth, seed)


def assembled(
    train: DataFrame, nodes: list[tuple], n_features: int, classes: int, label: str,
    trees: int, depth: int, seed: int,
) -> RandomForestClassificationModel:
    """The forest as Spark's own model: a saved stand-in of the same shape gets the grown nodes."""
    spark = train.sparkSession
    few = [([float(i % classes)] * n_features, i % classes) for i in range(2 * classes)]
    stand_in = spark.createDataFrame(few, "x array<double>, y int").select(
        array_to_vector("x").alias("features"), F.col("y").alias(label)
    )
    path = new_folder(spark, "forest")
    shape = RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed
    )
    shape.fit(stand_in.coalesce(1)).write().save(path)
    schema = spark.read.parquet(f"{path}/data").schema
    # A few thousand nodes, bounded by trees and depth.
    spark.createDataFrame(nodes, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)
