import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Give by weight, stop at the cap, give the excess again, until nothing is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    open_, left = set(order), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        give = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += give[s]
            cap = most * sizes[s]
            if target[s] >= cap:
                left += target[s] - cap
                target[s] = cap
                open_.discard(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_the_loop(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 50, 400, 9000]) for i in range(9)} | {None: 77, "é": 5}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    assert found == pytest.approx(plain_targets(sizes), rel=1e-9, abs=1e-6)


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    sizes = [rng.choice([1, 7, 300, 20_000, 0]) for _ in range(500)]
    start = [0.37] * 500
    p = mixing.flight(start, sizes, random.Random(2))
    assert sum(0 < x < 1 for x in p) <= 2
    assert sum(p) == pytest.approx(sum(start), abs=1e-5)
    total = sum(a * b for a, b in zip(start, sizes))
    assert sum(a * b for a, b in zip(p, sizes)) == pytest.approx(total, rel=1e-5)
    done = mixing.landing(start, p, sizes)
    assert set(done) <= {0.0, 1.0}
    assert abs(sum(a * b for a, b in zip(done, sizes)) - total) <= 20


def test_chances_are_met_on_average():
    sizes = [3, 5, 8, 13, 21, 34]
    n = 3000
    hits = [0.0] * 6
    for seed in range(n):
        for i, x in enumerate(mixing.flight([0.4] * 6, sizes, random.Random(seed))):
            hits[i] += x
    assert all(abs(h / n - 0.4) < 0.04 for h in hits)


def rows_of(spark, rows):
    numbered = [(i, *r, 0) for i, r in enumerate(rows)]
    schema = "row long, doc_id long, source string, size long, text_key long"
    return spark.createDataFrame(numbered, schema)


def test_sources_come_near_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 60)
    rng = random.Random(4)
    rows = [(i, f"s{i % 4}" if i % 3 else "big", rng.randint(1, 200)) for i in range(900)]
    rows += [(None, None, 10)] * 40 + [(7, "s1", 12)] * 50 + [(1000, "huge", 5000), (1001, "huge", 3)]
    frame = rows_of(spark, rows)
    found = mixing.mix(frame).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        assert 0 <= r["copies"] <= 2
        by.setdefault(r["source"], []).append(r)
    for source, own in by.items():
        taken = sum(r["copies"] * r["size"] for r in own)
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        if source != "huge":
            assert abs(taken - own[0]["target"]) <= 250, source
    again = mixing.mix(frame.repartition(3)).collect()
    key = lambda r: (r["row"], r["copies"])
    assert sorted(map(key, found)) == sorted(map(key, again))


@pytest.mark.parametrize("block", [150, 450])
def test_a_long_document_is_made_up_beside_a_large_source(spark, monkeypatch, block):
    """Sources of one block and of several, each with one very long document, null source too."""
    monkeypatch.setattr(mixing, "BLOCK", block)
    rng = random.Random(5)
    rows = [(i, "a-large", rng.randint(300, 700)) for i in range(1200)]
    at = 10_000
    for source in ("b", "c", "d", None):
        rows += [(at + i, source, rng.randint(300, 700)) for i in range(400)]
        rows.append((at + 400, source, 100_000))
        at += 1000
    found = mixing.mix(rows_of(spark, rows), weights=(5, 2, 2, 1, 2), share=0.7).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["source"], []).append(r)
    for source, own in by.items():
        wanted = own[0]["target"] / own[0]["source_size"]
        assert all(int(wanted) <= r["copies"] <= int(wanted) + 1 for r in own)
        taken = sum(r["copies"] * r["size"] for r in own)
        assert abs(taken - own[0]["target"]) <= 300, source


def test_turned_units_of_one_size_are_counted_out(spark):
    done = [(i, i, 0, 0, 5, "s", 5000, 2000.0, 1.0 if i < 700 else 0.0) for i in range(1000)]
    found = mixing.settled(spark.createDataFrame(done, mixing.ROW), 1).collect()
    assert sum(r["chance"] for r in found) == 400 and len({r["row"] for r in found}) == 1000
    assert all(r["chance"] == 0 for r in found if r["row"] >= 700)


def test_reruns_agree_whatever_the_splits(spark, monkeypatch, tmp_path):
    """Sources of many blocks, a doc_id with a third of all rows and equal rows, read in other splits."""
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rng = random.Random(6)
    rows = [(i, "t", f"s{i % 2}", "w " * rng.randint(0, 60)) for i in range(800)]
    rows += [(5, "t", "s1", "w " * rng.choice([7, 7, 30])) for _ in range(400)]
    rows += [(None, "t", None, "w w")] * 60
    frame = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    found = []
    for n, cores in ((1, 8), (4, 3), (13, 8)):
        spark.conf.set("spark.sql.shuffle.partitions", cores)
        path = f"{tmp_path}/{n}/documents.parquet"
        frame.orderBy(F.rand(n)).repartition(n).write.parquet(path)
        found.append(sorted(map(tuple, mixing.op7_mixing(spark, f"{tmp_path}/{n}").collect()), key=repr))
        docs = spark.read.parquet(path)
        found[-1].append(sorted(map(tuple, mixing.mixed(spark, docs, "").collect()), key=repr))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(found[0]) == len(rows) + 1
    assert found[0] == found[1] == found[2]


def test_equal_rows_are_numbered(spark):
    rows = [((p << 33) + i, 1, "s", 2, 0) for p in range(3) for i in range(4)] + [(99, None, None, 2, 0)]
    schema = "row long, doc_id long, source string, size long, text_key long"
    got = mixing.numbered(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["number"] for r in got if r["doc_id"] == 1) == list(range(12))
    assert [r["number"] for r in got if r["doc_id"] is None] == [0]


def test_empty_and_wordless(spark, documents):
    assert mixing.mix(rows_of(spark, [])).count() == 0
    found = mixing.mix(rows_of(spark, [(1, "a", 0), (2, None, 0)])).collect()
    assert sorted((r["copies"], r["target"]) for r in found) == [(0, 0.0), (0, 0.0)]
    docs = documents([(1, None), (2, ""), (3, "a b c"), (3, "a b c")])
    docs = docs.withColumn("row", docs["lang"]).withColumn("size", docs["lang"])
    kept = mixing.mixed(spark, docs, "")
    assert kept.columns == docs.columns
    # One source: all of it once, and half of it again.
    assert 6 <= sum(len((r["text"] or "").split()) for r in kept.collect()) <= 12


def test_word_counts(spark):
    texts = [("a b\tc\nd e\x1cf",), (" \n ",), (None,), ("x" * 100_000 + " y",)]
    found = spark.createDataFrame(texts, "text string").select(mixing.words().alias("n")).collect()
    assert [r["n"] for r in found] == [4, 0, 0, 2]
