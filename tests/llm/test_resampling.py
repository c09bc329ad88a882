import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from ledgerlens.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, run):
    own = words(text)
    return [" ".join(own[i : i + k]) for k in range(1, run + 1) for i in range(len(own) - k + 1)]


def plain(rows, target, run=1, buckets=10_000, percent=10, least=20):
    """Weights, scores and ranks by their definition."""
    at = lambda f: crc32(f.encode()) % buckets
    source, wanted = Counter(), Counter()
    for _, text in rows:
        source.update(map(at, grams(text, run)))
    for text in target:
        wanted.update(map(at, grams(text, run)))
    s_all, t_all = sum(source.values()) + buckets, sum(wanted.values()) + buckets
    out = []
    for doc_id, text in rows:
        own = [
            math.floor(1000 * math.log((wanted[b] + 1) * s_all / ((source[b] + 1) * t_all)))
            for b in map(at, grams(text, run))
        ]
        weight = sum(own) // len(own) if own else 0
        h = int(sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(own), weight, score, None])
    able = [r for r, (_, text) in zip(out, rows, strict=True) if len(words(text)) >= least]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for rank, row in enumerate(able[: len(able) * percent // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=repr)


def made_up(n=400):
    rng = np.random.default_rng(5)
    some = ["Alpha", "beta7", "ÉTÉ", "été", "x", "日本", "don't", "a_b", "42", "gamma", "δ"]
    return [(i, " ".join(rng.choice(some, rng.integers(0, 90)))) for i in range(n)]


ODD = [(None, "word " * 30), (900, None), (901, ""), (902, "--- ..."), (903, "\x00a\x7fb `c"), (0, "a")]


@pytest.mark.parametrize("run", [1, 3])
def test_matches_the_definition(spark, documents, run):
    rows, target = made_up() + ODD, ["Alpha beta7 x", None, "été été GAMMA 42"]
    docs = documents(rows).selectExpr("*", "lang AS score").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.ranked(docs, aim, run=run, buckets=500, percent=30, least_words=5)
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    assert sorted(got, key=repr) == plain(rows, target, run, 500, 30, 5)


def test_features_chain_over_parts(monkeypatch):
    text = "Some words, and MORE of 42 them: été " * 9
    for part in (1 << 20, 8):
        monkeypatch.setattr(resampling, "PART", part)
        for run in (1, 2, 4):
            got = [s for seeds in resampling.features(text.encode(), run) for s in seeds]
            assert sorted(got) == sorted(crc32(g.encode()) for g in grams(text, run))


def test_ties_and_repeated_rows(spark, documents):
    rows = [(7, "same words here")] * 6 + [(i, "") for i in range(3)]
    aim = spark.createDataFrame([], "text string")
    got = resampling.ranked(documents(rows), aim, percent=50, least_words=1).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert len(got) == 9


def test_drawn_documents_keep_their_columns(spark, documents):
    rows = made_up(100) + [(3, "another text " * 20)] * 4 + [(None, "w " * 50)]
    docs = documents(rows).selectExpr("*", "lang AS rank")
    aim = spark.createDataFrame([("another text",)], "text string")
    got = resampling.resample(docs, aim, percent=60).collect()
    ids = resampling.ranked(docs, aim, percent=60).filter("rank is not null").collect()
    assert sorted(r.rank_ for r in got) == sorted(r["rank"] for r in ids) == list(range(1, len(ids) + 1))
    texts = Counter(rows)
    assert all((r.doc_id, r.text) in texts and r["rank"] == "en" for r in got)
    assert {(r.doc_id, r.score, r.rank_) for r in got} == {(r.doc_id, r.score, r["rank"]) for r in ids}


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "text string")
    assert resampling.ranked(documents([]), none).count() == 0
    got = resampling.ranked(documents([(1, "a b")]), none).collect()
    assert len(got) == 1 and got[0]["rank"] is None
