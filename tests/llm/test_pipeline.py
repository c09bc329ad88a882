"""The pipeline and the registered queries."""

import inspect

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from ledgerlens.llm import queries
from tests.compare import connect, difference
from tests.llm.test_neardup import brute

SMALL = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, frames[-1], SMALL).persist()
        frames.append(after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns, name
    all_docs, good, single, clean, mix, packed = frames
    assert 0 < good.count() < all_docs.count()
    # One of each group of the documents that were kept before, and nothing else.
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(r[0] for r in brute(rows) if r[3])
    assert clean.count() == single.count()
    assert not clean.filter(r"text rlike '@mail[0-9]\\.example\\.com'").count()
    assert mix.select("doc_id").distinct().join(clean, "doc_id").count() == mix.select("doc_id").distinct().count()
    pieces = packed.groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in mix.collect()}


def test_everything_is_registered():
    names = set(contract.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in names}
    assert "pipeline" in names and set(queries.SQL) <= names
    assert all(len(inspect.signature(q).parameters) == 2 for q in queries.QUERIES.values())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_their_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.SQL[name]) is None
