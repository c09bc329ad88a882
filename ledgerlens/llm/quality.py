"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into overlapping chunks of bytes that cover all of it. Learned filters run over
each chunk, the strongest response of a filter in a chunk is kept, and the mean and the largest of
these over all chunks go through one logistic unit. Training fits on a bounded sample of labelled
rows, in one task; scoring sends the weights (about 30 KB, whatever the input) to every task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import batch_bytes, read_table, slices, with_score

CHUNK, STEP = 512, 448
WIDTH, STRIDE = 8, 4
DEPTH, FILTERS = 8, 32
TRAIN_ROWS = 1_500
"""Most labelled rows of each class that a network is fitted on."""
AT_ONCE = 256
"""Chunks whose windows are held at a time, in training as in scoring."""
KEEP_FROM = 0.3
"""Score from which a document is predicted to be of quality 1."""


def chunks(raw: bytes) -> np.ndarray:
    """Overlapping chunks of a document, one row each; short ones are filled with zero bytes."""
    count = 1 if len(raw) <= CHUNK else 1 + -(-(len(raw) - CHUNK) // STEP)
    whole = np.zeros((count - 1) * STEP + CHUNK, np.uint8)
    whole[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(whole, CHUNK)[::STEP]


@dataclass
class Network:
    """Weights; ``bias`` alone gives a constant score where there was nothing to learn from."""

    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(WIDTH * DEPTH)
        return cls(
            rng.normal(0, 1, (256, DEPTH)).astype(np.float32),
            rng.normal(0, scale, (WIDTH * DEPTH, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32),
            rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            0.0,
        )

    @classmethod
    def constant(cls, chance: float) -> Network:
        net = cls.fresh(0)
        net.out[:] = 0
        net.bias = float(np.log(chance / (1 - chance)))
        return net

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Every window of every chunk, embedded: a view, nothing is copied."""
        dense = self.embed[rows]
        n, size = len(rows), dense.itemsize
        return np.lib.stride_tricks.as_strided(
            dense,
            (n, (CHUNK - WIDTH) // STRIDE + 1, WIDTH * DEPTH),
            (CHUNK * DEPTH * size, STRIDE * DEPTH * size, size),
        )

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Strongest response of each filter in each chunk."""
        return self.strongest(rows)[0]

    def strongest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """That response, and the window it comes from."""
        found = np.empty((len(rows), FILTERS), np.float32)
        best = np.empty((len(rows), FILTERS), np.int64)
        for at in range(0, len(rows), AT_ONCE):
            some = self.windows(rows[at : at + AT_ONCE]) @ self.filters
            best[at : at + AT_ONCE] = some.argmax(axis=1)
            top = np.take_along_axis(some, best[at : at + AT_ONCE, None], 1)[:, 0]
            found[at : at + AT_ONCE] = np.maximum(top + self.shift, 0)
        return found, best

    def back(self, rows: np.ndarray, best: np.ndarray, grad: np.ndarray) -> tuple:
        """Gradients of filters and embedding from those of the strongest responses."""
        d_filters = np.zeros_like(self.filters)
        d_embed = np.zeros((256, DEPTH))
        for at in range(0, len(rows), AT_ONCE):
            some, own, flow = (x[at : at + AT_ONCE] for x in (rows, best, grad))
            each = np.arange(len(some))
            picked = self.windows(some)[each[:, None], own]
            d_filters += np.einsum("cf,cfk->kf", flow, picked)
            flow = (flow[:, :, None] * self.filters.T[None]).reshape(-1, DEPTH)
            where = (own * STRIDE)[:, :, None] + np.arange(WIDTH)
            bytes_at = some[each[:, None, None], where].reshape(-1)
            for k in range(DEPTH):
                d_embed[:, k] += np.bincount(bytes_at, flow[:, k], 256)
        return d_filters, d_embed

    def logits(self, features: np.ndarray) -> np.ndarray:
        return features @ self.out + self.bias


def combined(pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean and largest of the chunks of each document; ``starts`` holds its first chunk."""
    counts = np.diff(np.append(starts, len(pooled)))[:, None].astype(np.float32)
    mean = np.add.reduceat(pooled, starts, axis=0) / counts
    return np.hstack([mean, np.maximum.reduceat(pooled, starts, axis=0)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -40, 40)))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7, epochs: int = 14) -> Network:
    """Train by Adam on class-balanced log loss, over all chunks of every text.

    Without rows the score is a half; with one class only it is near that class.
    """
    if not len(texts):
        return Network.constant(0.5)
    if len(set(labels.tolist())) < 2:
        return Network.constant(0.99 if labels[0] else 0.01)
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    cut = [chunks(t) for t in texts]
    weight = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    names = ("embed", "filters", "shift", "out")
    state = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in names}
    state["bias"], step, size = [0.0, 0.0], 0, 32
    rounds = epochs * -(-len(texts) // size)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), size):
            step += 1
            some = order[at : at + size]
            rows = np.concatenate([cut[i] for i in some])
            counts = np.array([len(cut[i]) for i in some])
            starts = np.cumsum(counts) - counts
            pooled, best = net.strongest(rows)
            features = combined(pooled, starts)
            error = (sigmoid(net.logits(features)) - labels[some]) * weight[some] / len(some)
            error = error.astype(np.float32)
            back = error[:, None] * net.out
            doc = np.repeat(np.arange(len(some)), counts)
            is_max = pooled == features[doc, FILTERS:]
            grad = back[doc, :FILTERS] / counts[doc, None] + back[doc, FILTERS:] * is_max
            grad *= pooled > 0
            d_filters, d_embed = net.back(rows, best, grad)
            grads = {
                "embed": d_embed,
                "filters": d_filters,
                "shift": grad.sum(axis=0),
                "out": features.T @ error + 1e-4 * net.out,
                "bias": float(error.sum()),
            }
            rate = 0.01 * (1 - step / (rounds + 1))
            for k, g in grads.items():
                m, v = state[k]
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                state[k] = [m, v]
                move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                value = getattr(net, k) - move
                setattr(net, k, value if k == "bias" else value.astype(np.float32))
    return net


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of quality 1 for each whole document."""
    out = [np.zeros(0)]
    # About 20,000 chunks at a time; one very long document is pooled piece by piece.
    for part in slices([1 + len(t) // STEP for t in texts], 20_000):
        cut = [chunks(t) for t in texts[part]]
        counts = np.array([len(c) for c in cut])
        pooled = np.concatenate([net.pooled(c) for c in cut]) if len(cut) < 2 else net.pooled(
            np.concatenate(cut)
        )
        out.append(sigmoid(net.logits(combined(pooled, np.cumsum(counts) - counts))))
    return np.concatenate(out)


def held_out(doc_id) -> F.Column:
    """Rows that no label is learned from: CRC-32 of the id as text, divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = 7):
    """Fit on at most ``rows`` labelled documents of each class, in one task.

    The sample is the smallest hashes of doc_id, so it does not depend on partitioning. Labels
    that are null, or not 0 or 1, and rows without doc_id are not learned from.
    """
    known = labels.filter("quality in (0, 1)").select("doc_id", "quality")
    known = known.filter(~held_out(F.col("doc_id")))
    draw = F.xxhash64("doc_id", F.lit(seed))
    picked = [
        known.filter(F.col("quality") == q).orderBy(draw, "doc_id").limit(rows) for q in (0, 1)
    ]
    sample = documents.select("doc_id", "text").join(
        F.broadcast(picked[0].union(picked[1])), "doc_id"
    )
    # Repeated documents or labels may multiply the rows; the bound holds for what is fitted.
    sample = sample.orderBy(draw, "doc_id", "quality", "text").limit(2 * rows)

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(draw=[hash((seed, i)) for i in group["doc_id"]])
        group = group.sort_values(["draw", "doc_id", "quality", "text"], na_position="first")
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in group["text"]]
        net = fit(texts, group["quality"].to_numpy(np.int64), seed)
        return pd.DataFrame({"weights": [pickle.dumps(net.__dict__)]})

    found = sample.groupBy(F.lit("all")).applyInPandas(fitted, "weights binary").head()
    # Only numpy arrays that this job has just pickled itself are read back.
    return Network(**pickle.loads(found[0])) if found else Network.constant(0.5)


def score(documents: DataFrame, net: Network) -> DataFrame:
    """``documents`` with ``quality_score``; null and empty texts get the score of an empty chunk.

    An input column of that name is replaced. Rows, repeated ones too, stay one to one.
    """
    kept = documents.drop("quality_score")
    schema = with_score(kept, "quality_score")
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(net, batch_bytes(batch.column(at)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64())],
                names=[*batch.schema.names, "quality_score"],
            )

    return kept.mapInArrow(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(documents, read_table(spark, sf_dir, "labels"))
    return score(documents, net).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= KEEP_FROM).cast("int").alias("predicted"),
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier does not reject, columns as they came."""
    net = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, net).filter(F.col("quality_score") >= KEEP_FROM).select(*docs.columns)
