"""Importance resampling of documents towards a target, by hashed word features.

Texts stay bytes: a table of 256 bytes lower-cases A to Z and blanks all separators, and splitting
at blanks yields the words. The CRC-32 of a run of words goes on from that of the run without its
last word, and its remainder is the bucket of the feature. Counters add buckets up within tasks, and
Spark adds up the tasks. A document's weight is the mean gain of its features, where a bucket gains
what it is more frequent in the target than in the documents; a seeded Gumbel draw is added.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerlens.llm.common import read_table, unused, written

RUN = 1
BUCKETS = 10_000
"""Buckets of features; their counts and gains are the one thing every task gets."""
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
PART = 1 << 20
"""Bytes of a text that are split into words at a time."""
HELD = 1 << 18
"""Different features a task counts before it adds them to their buckets."""

_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
TABLE = bytes(b if b in _WORD else 0x20 for b in bytes(range(256)).lower())


def parts(text: bytes) -> Iterator[list[bytes]]:
    """Words of a whole text, in parts of bounded size."""
    clean, at = text.translate(TABLE), 0
    while len(clean) - at > PART:
        cut = clean.find(b" ", at + PART)
        if cut < 0:
            break
        yield clean[at:cut].split()
        at = cut
    yield clean[at:].split() if at else clean.split()


def features(text: bytes, run: int) -> Iterator[list[int]]:
    """CRC-32 of all runs of 1 to ``run`` consecutive words of a text."""
    before: list[bytes] = []
    for words in parts(text):
        # The words carried over have been counted, but runs may begin with them.
        together = before + words
        carried = len(before)
        seeds = list(map(crc32, together))
        yield seeds[carried:]
        spaced = [b" " + w for w in together] if run > 1 else []
        for more in range(1, min(run, len(together))):
            # A run of one word more goes on from the checksum of the shorter run.
            seeds = list(map(crc32, spaced[more:], seeds))
            yield seeds[max(0, carried - more) :]
        before = together[-(run - 1) :] if run > 1 else []


def _counted(run: int, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        held: Counter[int] = Counter()

        def settle() -> None:
            seeds = np.fromiter(held.keys(), np.int64, len(held))
            np.add.at(total, seeds % buckets, np.fromiter(held.values(), np.int64, len(held)))
            held.clear()

        for batch in batches:
            for text in batch.column("text"):
                for seeds in features(text.as_py() or b"", run):
                    held.update(seeds)
                    if len(held) > HELD:
                        settle()
        settle()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return rows


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all ``texts (text)`` in each bucket; one row for each bucket comes back."""
    found = texts.select(F.col("text").cast("binary")).mapInArrow(
        _counted(run, buckets), "bucket long, n long"
    )
    counts = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket in target and source."""
    buckets = len(source)
    in_source, in_target = int(source.sum()) + buckets, int(target.sum()) + buckets
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * in_source / ((s + 1) * in_target)))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def chance(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variate that follows from seed and doc_id alone."""
    name = "" if doc_id is None else doc_id
    h = int(sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_features long, weight long, score long, n_words long, text_key long"


def _scored(gain: np.ndarray, run: int, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
            for doc_id, key, text in zip(ids, keys, batch.column("text"), strict=True):
                n = words = total = 0
                for i, seeds in enumerate(features(text.as_py() or b"", run)):
                    at = np.fromiter(seeds, np.int64, len(seeds)) % len(gain)
                    total += int(gain[at].sum())
                    n += len(seeds)
                    if i == 0 or run == 1:
                        words += len(seeds)
                if run > 1:
                    words = sum(map(len, parts(text.as_py() or b"")))
                weight = total // n if n else 0
                out.append((doc_id, n, weight, weight + chance(doc_id, seed), words, key))
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in columns],
                [c.split()[0] for c in SCORED.split(", ")],
            )

    return rows


def ranked(
    docs: DataFrame,
    target: DataFrame,
    run: int = RUN,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Weight and score of every row of ``docs (doc_id, text)``, and its rank if it is drawn.

    Returns ``doc_id, n_features, weight, score, n_words, text_key, rank``. Of the rows with
    ``least_words`` words at least, ``percent`` in a hundred (rounded down) with the highest scores
    are drawn and ranked from 1; ties go to the smaller doc_id, null last, then to fewer features
    and the smaller key of the text; equal rows follow in any order. A null or empty text has no
    features and weight 0; a null doc_id draws as an empty one. Repeated rows are drawn
    each, other columns are not looked at, and an empty target (or no documents) leaves all counts
    of that side 0.
    """
    gain = gains(bucket_counts(docs, run, buckets), bucket_counts(target, run, buckets))
    text = F.col("text").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text).alias("text_key"),
    )
    scored = written(rows.mapInArrow(_scored(gain, run, seed), SCORED), "scored")
    able = scored.filter(F.col("n_words") >= least_words)
    # One row for each score: scores lie within the logarithms of the counts and of 2^32, times 1000.
    cells = able.groupBy("score").agg(F.count("*").alias("n")).collect()
    cells = sorted(((c["score"], c["n"]) for c in cells), reverse=True)
    wanted = sum(n for _, n in cells) * percent // 100
    above, ahead = [], 0
    for score, n in cells:
        if ahead >= wanted:
            break
        above.append((score, ahead))
        ahead += n
    kind = StructType([StructField("score", LongType()), StructField("ahead", LongType())])
    offsets = scored.sparkSession.createDataFrame(above, kind)
    least = above[-1][0] if above else None
    chosen = (F.col("n_words") >= least_words) & (F.col("score") >= F.lit(least))
    in_score = Window.partitionBy("score").orderBy(
        F.col("doc_id").asc_nulls_last(), "n_features", "text_key"
    )
    # Ranks are counted within a score only, and scores are spread by the draw.
    drawn = scored.filter(chosen).join(offsets, "score")
    drawn = drawn.withColumn("rank", F.col("ahead") + F.row_number().over(in_score))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.filter(~F.coalesce(chosen, F.lit(False))).withColumn(
        "rank", F.lit(None).cast("long")
    )
    return drawn.select(rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, and ``weight``, ``score`` and ``rank``.

    Settings and defined results are those of ``ranked``. A column of ``docs`` that has one of the
    new names keeps it, and the new one gets an underscore.
    """
    drawn = written(ranked(docs, target, **settings).filter("rank is not null"), "drawn")
    key, own = unused(docs, "text_key"), unused(docs, "drawn_id")
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("binary")))
    names = {c: unused(docs, c) for c in ("weight", "score", "rank")}
    found = drawn.select(
        F.col("doc_id").alias(own),
        F.col("text_key").alias("drawn_key"),
        *(F.col(c).alias(f"drawn_{c}") for c in names),
    )
    same = keyed["doc_id"].eqNullSafe(found[own]) & (keyed[key] == found["drawn_key"])
    # Copies of a row are told apart by nothing, so one of them stands for each that is drawn.
    texts = keyed.join(found.select(own, "drawn_key").distinct(), same, "left_semi")
    texts = texts.dropDuplicates(["doc_id", key])
    same = texts["doc_id"].eqNullSafe(found[own]) & (texts[key] == found["drawn_key"])
    both = texts.join(found, same)
    new = [F.col(f"drawn_{c}").alias(name) for c, name in names.items()]
    return both.select(*(texts[c] for c in docs.columns), *new)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of all ``documents``, drawn towards ``benchmark``."""
    docs, target = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return ranked(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: Checksums are computed bit by bit from the hexadecimal digits of each different word.
SQL = """
WITH poly AS (
  SELECT list_transform(range(256), lambda b: list_reduce(
    list_prepend(b, range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), words AS (
  SELECT 0 AS side, doc_id AS id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 1, item_id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark
), counted AS (
  SELECT side, id, word, count(*) AS n FROM words GROUP BY ALL
), hashed AS (
  SELECT word, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))),
      lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM counted), poly
), tokens AS (
  SELECT side, id, bucket, sum(n) AS n FROM counted JOIN hashed USING (word) GROUP BY ALL
), totals AS (
  SELECT sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM tokens
), buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s,
    coalesce(sum(n) FILTER (side = 1), 0) AS t FROM tokens GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((b.t + 1) * (coalesce(a.s, 0) + 10000))::DOUBLE
    / ((b.s + 1) * (coalesce(a.t, 0) + 10000))::DOUBLE))::BIGINT AS gain FROM buckets b, totals a
), means AS (
  SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::HUGEINT AS total
  FROM tokens JOIN gains USING (bucket) WHERE side = 0 GROUP BY id
), weights AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features > 0 THEN
      ((total - ((total % n_features) + n_features) % n_features) // n_features)::BIGINT
      ELSE 0 END AS weight,
    ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN means ON doc_id = id
), scored AS (
  SELECT doc_id, n_features, weight,
    (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score FROM weights
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank,
    10 * count(*) OVER () // 100 AS size FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= size THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (doc_id)
"""
