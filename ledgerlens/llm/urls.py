"""URL filter: rules first, then a learned verdict on the words of host and path.

Host names run words together. A unigram model over the words of the page texts gives the most
likely split of each host label (Viterbi): every substring of a label meets the word table in a
join, so neither the words nor the labels are held in one place. Host words and path tokens then
go through multinomial naive Bayes, learned from the URLs that a rule decides. Tokens are hashed
into a fixed number of slots, so the model has the same size for any corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import read_table, with_score, written

RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
PREFIX = 20
"""Longer words are looked for where their first PREFIX characters are found."""
LABELS_AT_ONCE = 2_000
"""Host labels that are split in one call."""
UNKNOWN = 10.0
"""An unknown piece of n characters is as likely as UNKNOWN^-n of one occurrence."""
SLOTS = 1 << 16
SMOOTH = 1.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(raw, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = (host == name) | F.endswith(host, F.lit(f".{name}"))
        fits = fits & F.startswith(path, F.lit(slash + rest))
        found = F.when(
            fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(found)
    return found


def unigrams(texts: DataFrame) -> DataFrame:
    """``word, n`` over the whole texts of all pages, tags left out."""
    plain = F.lower(F.regexp_replace("html", "<[^>]*>", " "))
    words = F.explode(F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), 0))
    return texts.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def best_split(label: str, logs: dict[str, float], total: float) -> list[str]:
    """Most likely words of a label; unknown characters in a row are joined into one token.

    An unknown piece costs the same for each character wherever it begins, so the best beginning
    so far is all that has to be kept of it, and labels and words may be of any length.
    """
    base, unknown = np.log(max(total, 1.0)), np.log(UNKNOWN)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(len(label) + 1)]
    for word, value in logs.items():
        at = label.find(word)
        while at >= 0:
            ending[at + len(word)].append((at, value))
            at = label.find(word, at + 1)
    best, back = [0.0] + [-np.inf] * len(label), [0] * (len(label) + 1)
    opened, begun = 0, 0.0
    for end in range(1, len(label) + 1):
        choices = [(begun - unknown * end - base, -opened)]
        choices += [(best[start] + value - base, -start) for start, value in ending[end]]
        best[end], start = max(choices)
        back[end] = -start
        if best[end] + unknown * end > begun:
            opened, begun = end, best[end] + unknown * end
    words, end = [], len(label)
    while end:
        words.append(label[back[end] : end])
        end = back[end]
    return words[::-1]


def pieces_of(labels: DataFrame, words: DataFrame) -> DataFrame:
    """``label, word, n``: every word of the table that occurs in a label.

    All substrings of up to PREFIX characters meet the table. A longer word is tried only where
    its first PREFIX characters stand, and only in the lengths that words with that beginning have.
    """
    size = F.length("label")
    starts = labels.withColumn("start", F.explode(F.sequence(F.lit(1), size)))
    reach = F.least(F.lit(PREFIX), size - F.col("start") + 1)
    short = starts.select("label", "start", F.explode(F.sequence(F.lit(1), reach)).alias("n_chars"))
    piece = F.substring("label", F.col("start"), F.col("n_chars")).alias("word")
    head = F.substring("word", 1, PREFIX).alias("head")
    lengths = words.filter(F.length("word") > PREFIX).select(head, F.length("word").alias("n_chars"))
    long = starts.filter(size - F.col("start") >= PREFIX)
    long = long.withColumn("head", F.substring("label", F.col("start"), F.lit(PREFIX)))
    long = long.join(lengths.distinct(), "head").filter(F.col("start") + F.col("n_chars") - 1 <= size)
    pieces = short.select("label", piece).unionByName(long.select("label", piece))
    return pieces.distinct().join(words, "word").select("label", "word", "n")


def segmented(labels: DataFrame, words: DataFrame) -> DataFrame:
    """``label, tokens`` for distinct host labels of any length."""
    total = float(words.agg(F.sum("n")).head()[0] or 0)
    calls = max(1, -(-labels.count() // LABELS_AT_ONCE))
    alone = labels.select("label", F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("n"))
    known = pieces_of(labels, words).unionByName(alone)
    known = known.withColumn("call", F.pmod(F.xxhash64("label"), F.lit(calls)))

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for label, own in rows.groupby("label", sort=False):
            own = own[own["n"].notna()].sort_values("word")
            logs = dict(zip(own["word"], np.log(own["n"].astype(float)), strict=True))
            found.append((label, best_split(label, logs, total)))
        return pd.DataFrame(found, columns=["label", "tokens"])

    return known.groupBy("call").applyInPandas(split, "label string, tokens array<string>")


_TOKEN = re.compile(r"[^\W\d_]+|\d+")


def path_tokens(path: str) -> list[str]:
    """Words of a path in lower case; numbers count by their length only."""
    return [f"/{len(t)}#" if t.isdigit() else f"/{t}" for t in _TOKEN.findall(path.lower())]


@lru_cache(maxsize=100_000)
def slot(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % SLOTS


def slots_of(tokens: list[str], path: str) -> list[int]:
    return [slot(t) for t in tokens] + [slot(t) for t in path_tokens(path)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slot counts by verdict of a task's URLs; slot -1 counts the URLs themselves."""
    counts = {"block": np.zeros(SLOTS + 1, np.int64), "allow": np.zeros(SLOTS + 1, np.int64)}
    for batch in batches:
        rows = zip(
            batch.column("tokens").to_pylist(), batch.column("path").to_pylist(),
            batch.column("verdict").to_pylist(), strict=True,
        )
        for tokens, path, verdict in rows:
            np.add.at(counts[verdict], slots_of(tokens or [], path) + [SLOTS], 1)
    for verdict, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([verdict] * len(at), pa.string()), pa.array(at), pa.array(n[at])],
            names=["verdict", "slot", "n"],
        )


def fit(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Log odds of block over allow for each slot, and for the verdicts themselves."""
    counted = rows.mapInArrow(_count, "verdict string, slot long, n long")
    # At most SLOTS + 1 rows of two verdicts reach the driver.
    totals = counted.groupBy("verdict", "slot").agg(F.sum("n").alias("n")).toPandas()
    n = {v: np.zeros(SLOTS + 1) for v in ("block", "allow")}
    for v in n:
        mine = totals[totals["verdict"] == v]
        n[v][mine["slot"].to_numpy(int)] = mine["n"].to_numpy(float)
    used = max(1, int(((n["block"] + n["allow"])[:SLOTS] > 0).sum()))
    log = {v: np.log((c[:SLOTS] + SMOOTH) / (c[:SLOTS].sum() + SMOOTH * used)) for v, c in n.items()}
    prior = np.log((n["block"][SLOTS] + SMOOTH) / (n["allow"][SLOTS] + SMOOTH))
    return log["block"] - log["allow"], float(prior)


def _judge(odds: np.ndarray, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(
                batch.column("tokens").to_pylist(), batch.column("path").to_pylist(), strict=True
            )
            score = [prior + float(odds[slots_of(t or [], p)].sum()) for t, p in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64())],
                names=[*batch.schema.names, "score"],
            )

    return run


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for each row of ``pages (page_id, url, html)``.

    ``score`` is the log odds of blocking; where no rule fits, a positive score blocks. A URL that
    is null or has no ``://`` has empty parts and is judged by the share of blocked URLs alone.
    Repeated rows and null ids come through as they are.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    hosts = written(urls.select("host").distinct(), "hosts")
    parts = hosts.select("host", F.posexplode(F.split("host", "[^\\p{L}\\p{N}]+")).alias("at", "label"))
    parts = parts.filter("label <> ''")
    words = written(unigrams(pages.select("html")), "words")
    split = segmented(written(parts.select("label").distinct(), "labels"), words)
    listed = parts.join(split, "label").groupBy("host").agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))), lambda x: x["tokens"])
        ).alias("tokens")
    )
    rows = urls.join(written(listed, "host-words"), "host", "left")
    known = rows.filter("_rule is not null").select("tokens", "path", "_rule.verdict")
    odds, prior = fit(known)
    schema = with_score(rows, "score")
    scored = rows.mapInArrow(_judge(odds, prior), schema)
    learned = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", learned).alias("verdict"),
        "score",
        "tokens",
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return judge(read_table(spark, sf_dir, "pages")).drop("tokens")
