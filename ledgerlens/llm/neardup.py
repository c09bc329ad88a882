"""Near-duplicate documents by HyperMinHash.

Sketches keep, per bucket, the leading zeros and ten mantissa bits of a minimum (16 bits instead
of 64). Bands of compressed registers propose pairs, the collision-corrected estimate drops those
far below the threshold, and the rest is confirmed on full shingle sets.

Equal texts become one class before anything else, so a group of copies is one row. In a bucket,
members are first compared with one leader (linear in the bucket); only members of buckets that
still span several components are then compared across components, in blocks, first each with its
most similar partners, then with all that the sketches leave open. Links inside a component that
is already connected cannot change the result and are not looked for.

Chance of losing a link at the threshold: 32 bands of 3 registers miss a pair of similarity 0.75
with probability (1 - 0.75^3)^32 = 2e-8; the estimate of 192 registers has a deviation of 0.031
there, and its cut of 0.59 is five deviations below. Members of buckets that stay open are
compared by 1024 further minima of one byte each, with a cut five deviations below as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import read_table, unused, written
from ledgerlens.llm.components import components
from ledgerlens.llm.shingles import (
    FINE,
    REGISTERS,
    fine_estimate,
    fine_sketch,
    jaccard_estimate,
    linked,
    shingle_set,
    sketch,
)

PERCENT = 75
BANDS, ROWS = 32, 3
SLACK = 0.16
"""How far below the threshold an estimate may be before a pair is dropped unconfirmed."""
FINE_SLACK = 0.07
"""The same for the estimate of 1024 bytes, whose deviation at the threshold is 0.0135."""
BLOCK = 512
"""Members of a bucket that are compared with another such block in one task."""
CELL_ROWS = 4096
"""Rows of small buckets that one call compares; each bucket by itself."""
BEST = 4
"""Partners of a member that are confirmed before all others of its bucket."""


def text_key(text="text") -> F.Column:
    """128 bits that stand for a whole text."""
    return F.unhex(F.md5(F.col(text)))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, found = [], []
        for text in batch.column("text").to_pylist():
            hashes = shingle_set(text)
            sizes.append(len(hashes))
            found.append(sketch(hashes).tobytes() if len(hashes) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(found, pa.binary()),
            ],
            names=["key", "doc_id", "n", "sketch"],
        )


def classes_of(docs: DataFrame) -> DataFrame:
    """One row per distinct text: ``node, key, doc_id`` (smallest), ``n`` and ``sketch``."""
    texts = docs.select(text_key().alias("key"), F.col("doc_id").cast("long"), "text")
    rows = texts.filter("text is not null").mapInArrow(
        _sketches, "key binary, doc_id long, n long, sketch binary"
    )
    # Two steps: sketches are made once, and a group of copies is combined before the shuffle.
    found = written(rows, "sketches").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    # Numbers are fixed by writing them; they only name classes inside this run.
    return written(found.withColumn("node", F.monotonically_increasing_id()), "classes")


def _fine_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fine_sketch(shingle_set(t)).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(found, pa.binary())], names=["node", "fine"]
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = np.asarray(batch.column("node"))
        regs = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16)
        regs = regs.reshape(-1, REGISTERS)[:, : BANDS * ROWS].astype(np.int64)
        regs = regs.reshape(-1, BANDS, ROWS)
        bucket = np.arange(BANDS, dtype=np.int64)[None, :] << 48
        for i in range(ROWS):
            bucket = bucket | regs[:, :, i] << (16 * i)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket.ravel()), pa.array(np.repeat(nodes, BANDS))], names=["bucket", "node"]
        )


def _sketch_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b`` of ``members`` with both sizes and sketches."""
    own = classes.select("node", "n", "sketch")
    first = own.toDF("a", "n_a", "sketch_a")
    return members.join(first, "a").join(own.toDF("b", "n_b", "sketch_b"), "b")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def _likely(least: float):
    """Keep pairs whose sizes and registers allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (
                _matrix(batch.column("sketch_a").to_pylist())
                == _matrix(batch.column("sketch_b").to_pylist())
            ).sum(axis=1)
            guess = jaccard_estimate(
                same, np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b"))
            )
            yield batch.select(["a", "b"]).filter(pa.array(guess >= least))

    return run


@lru_cache(maxsize=64)
def _cached_set(text: str) -> np.ndarray:
    return shingle_set(text)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                linked(_cached_set(x), _cached_set(y), percent)
                for x, y in zip(
                    batch.column("text_a").to_pylist(),
                    batch.column("text_b").to_pylist(),
                    strict=True,
                )
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Search:
    """State of one run: classes, bucket members, confirmed links and components so far."""

    def __init__(self, docs: DataFrame, percent: int):
        self.docs, self.percent = docs, percent
        self.least = percent / 100 - SLACK
        self.classes = classes_of(docs)
        bands = self.classes.filter("n > 0").mapInArrow(_bands, "bucket long, node long")
        full = bands.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("size"))
        self.members = written(bands.join(full.filter("size > 1"), "bucket"), "members")
        involved = self.members.select("node").distinct()
        keys = self.classes.join(involved, "node").select("node", "key")
        texts = docs.filter("text is not null").select(text_key().alias("key"), "text")
        self.texts = written(
            texts.join(keys, "key").groupBy("node").agg(F.first("text").alias("text")), "texts"
        )
        fine = self.texts.mapInArrow(_fine_sketches, "node long, fine binary")
        self.fine = written(
            fine.join(self.classes.select("node", "n", "sketch"), "node"), "fine-sketches"
        )
        self.roots: DataFrame | None = None
        self.tried: DataFrame | None = None

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Links among ``pairs (a, b)`` that were not tried before; remembers them as tried."""
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        first = self.texts.toDF("a", "text_a")
        second = self.texts.toDF("b", "text_b")
        sure = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
        return written(sure.mapInArrow(_confirm(self.percent), "a long, b long"), "links")

    def merge(self, links: DataFrame) -> None:
        """Take new links into the components."""
        if self.roots is None:
            self.roots = components(links)
            return
        own = self.roots
        for side in ("a", "b"):
            name = own.select(F.col("node").alias(side), F.col("root").alias("to"))
            links = links.join(name, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        over = components(links.filter("a <> b"))
        up = over.select(F.col("node").alias("root"), F.col("root").alias("to"))
        moved = own.join(up, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        fresh = over.join(own, "node", "left_anti")
        self.roots = written(moved.union(fresh), "roots")

    def stars(self) -> None:
        """Every member of a bucket against the bucket's leader."""
        pairs = self.members.filter("node <> leader").select(
            F.col("leader").alias("a"), F.col("node").alias("b")
        )
        likely = _sketch_pairs(pairs.distinct(), self.classes).select(
            "a", "b", "n_a", "n_b", "sketch_a", "sketch_b"
        )
        self.merge(self.confirm(likely.mapInArrow(_likely(self.least), "a long, b long")))

    def open_members(self) -> DataFrame:
        """Members of buckets that hold several components, with what a comparison needs."""
        rooted = self.members.join(self.roots, "node", "left").select(
            "bucket", "node", "size", F.coalesce("root", "node").alias("root")
        )
        mixed = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        mixed = written(mixed.filter("lo <> hi").select("bucket"), "mixed")
        # A bucket of two was settled by its leader.
        rooted = rooted.filter("size > 2").join(mixed, "bucket")
        return rooted.join(self.fine, "node")

    def across(self, best: int | None) -> None:
        """Members of different components in one bucket, block by block."""
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        rows = self.open_members().withColumn("blocks", blocks)
        rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        # Each block meets itself and every other: a member goes to one cell per block.
        cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = written(
            cells.select(
                "bucket",
                F.least("block", "other").alias("low"),
                F.greatest("block", "other").alias("high"),
                "block", "node", "root", "n", "sketch", "fine",
            ),
            "cells",
        )
        groups = max(1, -(-cells.count() // CELL_ROWS))
        dealt = F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(groups))
        pairs = cells.withColumn("group", dealt).groupBy("group").applyInPandas(
            _cross_pairs(self.least, self.percent / 100 - FINE_SLACK, best), "a long, b long"
        )
        self.merge(self.confirm(pairs.distinct()))


def _cell_pairs(cell: dict[str, np.ndarray], least: float, fine_least: float, best: int | None):
    """Likely pairs across components between the two blocks of one cell."""
    left = np.flatnonzero(cell["block"] == cell["low"][0])
    right = np.flatnonzero(cell["block"] == cell["high"][0])
    same_block = cell["low"][0] == cell["high"][0]
    nodes, roots, sizes = cell["node"][right], cell["root"][right], cell["n"][right]
    regs, fine = cell["sketch"][right], cell["fine"][right]
    for i in left:
        other = roots != cell["root"][i]
        if same_block:
            other &= nodes > cell["node"][i]
        at = np.flatnonzero(other)
        guess = jaccard_estimate((regs[at] == cell["sketch"][i]).sum(axis=1), cell["n"][i], sizes[at])
        at = at[guess >= least]
        guess = fine_estimate((fine[at] == cell["fine"][i]).sum(axis=1))
        at, guess = at[guess >= fine_least], guess[guess >= fine_least]
        # A pair that shares several buckets is proposed in the first of them only. That one is
        # open too, or it holds just these two, and then its leader has settled them.
        bands = (regs[at] == cell["sketch"][i])[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
        first = bands.all(axis=2).argmax(axis=1) == cell["band"][i]
        at, guess = at[first], guess[first]
        if best is not None:
            at = at[np.lexsort((nodes[at], -guess))[:best]]
        yield np.minimum(nodes[at], cell["node"][i]), np.maximum(nodes[at], cell["node"][i])


def _cross_pairs(least: float, fine_least: float, best: int | None):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bucket", "low", "high", "node"])
        columns = {c: group[c].to_numpy() for c in ("low", "high", "block", "node", "root", "n")}
        columns["band"] = group["bucket"].to_numpy() >> 48
        columns["sketch"] = _matrix(group["sketch"])
        columns["fine"] = np.frombuffer(b"".join(group["fine"]), np.uint8).reshape(-1, FINE)
        key = group[["bucket", "low", "high"]].to_numpy()
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, end in zip(starts, np.append(starts[1:], len(key)), strict=True):
            cell = {c: v[start:end] for c, v in columns.items()}
            for a, b in _cell_pairs(cell, least, fine_least, best):
                found_a.append(a)
                found_b.append(b)
        found = pd.DataFrame({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})
        return found.drop_duplicates()

    return run


def link(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``key, root, n, component_id`` for every distinct text of ``docs (doc_id, text)``.

    ``root`` names a component of this run and is null for texts without words, which are linked
    with nothing. ``component_id`` is the smallest doc_id of the component, null where none has
    one. Texts that differ only in case or blanks have equal sets and are linked like any others.
    """
    search = _Search(docs, percent)
    search.stars()
    search.across(BEST)
    search.across(None)
    found = search.classes.join(search.roots, "node", "left").select(
        "key", "n", "doc_id", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root")
    )
    lowest = found.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return written(found.join(lowest, "root", "left").select("key", "root", "n", "component_id"), "linked")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with ``n_shingles``, ``component_id`` and ``kept``.

    Columns of those names are replaced; all others pass through. Documents without words have no shingles and are their
    own component. Repeated rows share a component, and all rows with its smallest doc_id are
    kept. A missing doc_id is never the smallest unless no row of the component has one; a row
    without doc_id is kept only in that case.
    """
    docs = docs.drop("n_shingles", "component_id", "kept")
    return _marked(docs, percent, _key_name(docs), _root_name(docs)).drop(_key_name(docs), _root_name(docs))


def _key_name(docs: DataFrame) -> str:
    return unused(docs, "text_key")


def _root_name(docs: DataFrame) -> str:
    return unused(docs, "root_class")


def _marked(docs: DataFrame, percent: int, key: str, root: str) -> DataFrame:
    """``docs`` with the three columns, and the names of text and component in ``key, root``."""
    found = link(docs, percent).select(
        F.col("key").alias(key), F.col("root").alias(root), F.col("n").alias("n_shingles"), "component_id"
    )
    rows = docs.withColumn(key, text_key()).join(found, key, "left")
    own = F.when(F.col(root).isNull(), F.col("doc_id").cast("long"))
    rows = rows.withColumns(
        {
            "n_shingles": F.coalesce("n_shingles", F.lit(0).cast("long")),
            "component_id": F.coalesce(own, "component_id"),
        }
    )
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and keeper flag of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, and every document without words."""
    # Columns named like the marks are set aside by other names meanwhile.
    marks = {c: unused(docs, c) for c in ("n_shingles", "component_id", "kept") if c in docs.columns}
    rows = docs.withColumnsRenamed(marks)
    root = _root_name(rows)
    kept = _marked(rows, PERCENT, _key_name(rows), root).filter("kept")
    # Rows repeated under one doc_id are all keepers of their group: one of them stays.
    roots = kept.filter(F.col(root).isNotNull()).groupBy(root).agg(F.count("*").alias("rows"))
    repeated = written(roots.filter("rows > 1").select(root), "repeated")
    single = kept.join(repeated, root, "left_anti")
    again = kept.join(repeated, root, "left_semi").dropDuplicates([root])
    found = single.union(again).select(*rows.columns)
    return found.withColumnsRenamed({v: k for k, v in marks.items()})


SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (
    SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS n_common
    FROM items l JOIN items r ON l.x = r.x AND l.doc_id < r.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM shared
    JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
    WHERE 100 * n_common >= 75 * (len(p.s) + len(q.s) - n_common)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM sets
    UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id,
    s.doc_id = min(r.b) AS kept
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""
