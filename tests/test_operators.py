"""Joins, cross tables, rankings, sampling and quantiles against brute force."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.quantiles import approx_quantiles, exact_quantiles, many_quantiles
from ledgerlens.operators import crosstab, joins, profiling, ranking, sampling, skew
from tests.conftest import day, rows


def test_lookup_keeps_rows_without_a_match(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, x string")
    table = spark.createDataFrame([(2, "t", "unused")], "k int, y string, z string")
    assert rows(joins.lookup(facts, table, "k", ["y"])) == [
        (1, "a", None), (2, "b", "t"), (2, "c", "t"),
    ]


def test_mark_adds_no_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    members = spark.createDataFrame([(2,)] * 50 + [(None,)], "k int")
    assert rows(joins.mark_exists(df, "k", members, "m")) == [
        (1, False), (2, True), (None, False),
    ]


def third_on_one_key(spark, n=9000):
    """Rows of which a third have key 7; some keys are null or unknown to the table."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, None).otherwise(F.col("id"))
    return spark.range(n).select("id", key.cast("bigint").alias("k"))


def test_hot_keys_are_found_and_few(spark):
    assert skew.hot_keys(third_on_one_key(spark), "k", 500) == {7: 7}
    nulls = spark.range(9000).select(F.when(F.col("id") > 4000, F.col("id")).alias("k"))
    assert skew.hot_keys(nulls, "k", 1000) == {None: 5}
    assert skew.hot_keys(spark.range(9000), "id", 500) == {}
    assert skew.hot_keys(spark.range(0), "id") == {}


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("rows_per_task", [50, 500, 10_000])
def test_salted_lookup_equals_the_plain_join(spark, how, rows_per_task):
    facts = third_on_one_key(spark)
    table = spark.range(0, 8000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    expected = rows(facts.join(table, "k", how), "id", "k", "v")
    spread = skew.salted_lookup(facts, table, "k", ["v"], how, rows_per_task)
    assert rows(spread, "id", "k", "v") == expected


def test_salt_spreads_the_hot_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.range(0, 9000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
        per_task = {}
        for name, df in (
            ("plain", joins.lookup(third_on_one_key(spark), table, "k", ["v"])),
            ("salted", skew.salted_lookup(third_on_one_key(spark), table, "k", ["v"], rows_per_task=300)),
        ):
            sizes = df.groupBy(F.spark_partition_id()).count().collect()
            per_task[name] = max(r["count"] for r in sizes)
        assert per_task["plain"] > 3000 and per_task["salted"] < 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def pairs_by_hand(events, reports):
    """(event, prior reports, reports) by comparing every event with every report."""
    out = []
    for key, when in events:
        mine = [d for k, d in reports if k == key and key is not None]
        prior = sum(1 for d in mine if d is not None and when is not None and when >= d)
        out.append((key, when, len(mine), prior))
    return sorted(out, key=repr)


def test_report_history_equals_the_pairwise_join(spark):
    rng = random.Random(7)
    days = [day(f"2001-01-{d:02d}") for d in range(1, 29)] + [None]
    # One customer owns about half of everything.
    pick = lambda: rng.choice([1, 1, 1, 2, 3, 4, None])
    events = sorted({(pick(), rng.choice(days)) for _ in range(120)}, key=repr)
    reports = [(pick(), rng.choice(days)) for _ in range(60)]
    got = joins.report_history(
        spark.createDataFrame(events, "c int, d date"),
        spark.createDataFrame(reports, "c int, r date"),
        "c", "d", "r",
    )
    assert rows(got, "c", "d", "n_reports", "n_prior_reports") == pairs_by_hand(events, reports)


def test_report_history_with_times_over_several_months(spark):
    rng = random.Random(8)
    whens = [dt.datetime(2001, 1, 30) + dt.timedelta(hours=7 * i) for i in range(200)] + [None]
    pick = lambda: rng.choice([1, 1, 1, 2, None])
    events = sorted({(pick(), rng.choice(whens)) for _ in range(150)}, key=repr)
    reports = [(pick(), rng.choice(whens)) for _ in range(80)]
    got = joins.report_history(
        spark.createDataFrame(events, "c int, d timestamp"),
        spark.createDataFrame(reports, "c int, r timestamp"),
        "c", "d", "r",
    )
    assert rows(got, "c", "d", "n_reports", "n_prior_reports") == pairs_by_hand(events, reports)


def test_report_history_group_is_bounded_by_days(spark):
    """A hot key with very many events reaches the window as one row per day."""
    hot = spark.range(20_000).select(
        F.lit(1).alias("c"),
        F.date_add(F.lit(day("2001-01-01")), (F.col("id") % 10).cast("int")).alias("d"),
    )
    days = hot.groupBy("c", "d").agg(F.count(F.lit(1)).alias("n"))
    got = joins.report_history(
        days, hot.select("c", F.col("d").alias("r")), "c", "d", "r"
    ).orderBy("d").collect()
    assert [(r.n, r.n_reports, r.n_prior_reports) for r in got] == [
        (2000, 20_000, 2000 * (i + 1)) for i in range(10)
    ]


def test_crosstab_drops_missing_keys_and_keeps_unlisted_values(spark):
    df = spark.createDataFrame(
        [("a", "x"), ("a", "x"), ("a", "y"), ("b", "new"), ("b", None), (None, "x")],
        "r string, c string",
    )
    counts = crosstab.crosstab_counts(df, "r", "c")
    wide = crosstab.crosstab_matrix(counts, "r", "c", ["x", "y"], ["x_pct", "y_pct"])
    assert rows(wide) == [("a", 66.67, 33.33, 0.0), ("b", 0.0, 0.0, 100.0)]
    by_column = crosstab.crosstab_matrix(
        counts, "r", "c", ["x", "y"], ["x_pct", "y_pct"], by="column"
    )
    assert rows(by_column) == [("a", 100.0, 100.0, 0.0), ("b", 0.0, 0.0, 100.0)]
    assert rows(crosstab.crosstab_pct(counts, "r", "c"), "r", "c", "pct") == [
        ("a", "x", 66.67), ("a", "y", 33.33), ("b", "new", 100.0),
    ]


def test_rankings_break_ties_and_put_nulls_last(spark):
    data = [("b", 2.0), ("a", 2.0), ("c", None), ("d", -9.0)]
    df = spark.createDataFrame(data, "k string, m double")
    assert [r.k for r in ranking.order_desc(df, "m", "k").collect()] == ["a", "b", "d", "c"]
    assert [r.k for r in ranking.top(df, "m", 2, "k").collect()] == ["a", "b"]
    by_size = ranking.top_by_size(df, "m", 2, F.col("m"), "k")
    assert [r.k for r in by_size.collect()] == ["d", "a"]
    assert rows(ranking.leading_key(df, "k", "m")) == [("a", 2.0)]
    grouped = df.withColumn("g", F.lit(1))
    assert rows(ranking.leading_per_group(grouped, "g", "k", "m"), "k") == [("a",)]


def sampled_by_hand(data, quota):
    """First ``quota[label]`` rows of each class in draw order."""
    import hashlib

    picked = set()
    for label, size in quota.items():
        ids = [i for i, y in data if y == label]
        ids.sort(key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
        picked |= set(ids[:size])
    return picked


@pytest.mark.parametrize(("zeros", "ones"), [(900, 100), (97, 3), (5, 1), (50, 50)])
def test_split_is_exact(spark, zeros, ones):
    data = [(i, int(i < ones)) for i in range(zeros + ones)]
    df = spark.createDataFrame(data, "id int, y int")
    split = sampling.stratified_split(df, "y", sampling.draw_key(["id"]))
    got = {r.id for r in split.collect() if r.is_train}
    n = len(data)
    train = n - int(np.ceil(n * 0.2))
    share = {0: train * zeros / n, 1: train * ones / n}
    quota = {c: int(share[c]) for c in share}
    by_remainder = sorted(share, key=lambda c: (-(share[c] - quota[c]), c))
    for c in by_remainder[: train - sum(quota.values())]:
        quota[c] += 1
    assert got == sampled_by_hand(data, quota)
    assert len(got) == train


def test_sample_keeps_the_ratio_and_needs_no_order(spark):
    data = [(i, int(i % 10 == 0)) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, y int")
    once = sampling.stratified_sample(df, "y", sampling.draw_key(["id"]), cap=500)
    again = sampling.stratified_sample(df.repartition(7), "y", sampling.draw_key(["id"]), cap=500)
    assert rows(once) == rows(again)
    assert Counter(r.y for r in once.collect()) == {0: 450, 1: 50}
    assert {r.id for r in once.collect()} == sampled_by_hand(data, {0: 450, 1: 50})
    assert sampling.stratified_sample(df, "y", sampling.draw_key(["id"]), cap=3000).count() == 3000


def test_union_of_strata_keeps_everything(spark):
    parts = [spark.createDataFrame([(i, c)], "id int, y int") for i, c in ((1, 0), (2, 1))]
    assert rows(sampling.union_strata(parts)) == [(1, 0), (2, 1)]


PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)


@pytest.mark.parametrize("kind", ["uniform", "hot value", "two values", "few", "one"])
def test_quantiles_equal_numpy(spark, kind):
    """Above and below the size where the sketch takes over; a hot value holds a third."""
    rng = np.random.default_rng(3)
    values = {
        "uniform": rng.normal(size=60_000).round(4),
        "hot value": np.where(np.arange(60_000) % 3 == 0, 7.0, rng.integers(0, 5000, 60_000)),
        "two values": np.where(np.arange(50_000) < 12_500, 1.0, 2.0),
        "few": np.array([3.0, 1.0, 2.0]),
        "one": np.array([4.0]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = exact_quantiles(df.repartition(5), "v", PROBS).first()["quantiles"]
    assert got == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-15, abs=1e-12)


def test_many_quantiles_equal_numpy(spark):
    """Side by side: all different, a hot value, zeros of both signs with infinity, one value."""
    rng = np.random.default_rng(4)
    n = 50_003
    values = {
        "even": rng.normal(size=n),
        "hot": np.where(rng.random(n) < 0.6, 7.0, rng.integers(0, 900, n)),
        "zeros": np.where(rng.random(n) < 0.02, np.inf, np.where(rng.random(n) < 0.5, -0.0, rng.integers(-1, 2, n))),
        "one": np.full(n, 3.0),
    }
    probs = [i / 32 for i in range(32)]
    columns = [v.tolist() for v in values.values()]
    df = spark.createDataFrame(list(zip(*columns)), ", ".join(f"{c} double" for c in values))
    for part, some in ((df.repartition(5), n), (df.limit(2).coalesce(1), 2)):
        held = part.toPandas() if some == 2 else values
        got = many_quantiles(part, list(values), probs)
        for c in values:
            with np.errstate(invalid="ignore"):
                expected = np.quantile(np.asarray(held[c]), probs)
            assert got[c] == pytest.approx(expected.tolist(), rel=1e-14, abs=1e-14)


def test_grouped_quantiles(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.integers(0, 100, 40_000), "b": np.arange(11)}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r["quantiles"] for r in exact_quantiles(df, "v", PROBS, by="g").collect()}
    assert got == {g: list(np.quantile(vs, PROBS)) for g, vs in groups.items()}


def test_approximate_quantiles_are_close(spark):
    df = spark.range(100_000).select(F.col("id").cast("double").alias("v"))
    got = approx_quantiles(df, "v", PROBS).first()["quantiles"]
    assert got == pytest.approx([0, 25_000, 50_000, 75_000, 99_999], abs=20)


def test_describe_matches_pandas(spark):
    rng = np.random.default_rng(11)
    values = rng.integers(0, 1000, 500)
    df = spark.createDataFrame([(int(v),) for v in values] + [(None,)], "v int")
    got = profiling.describe({"t": df}, {"t": ["v"]}).first()
    want = pd.Series(values).describe()
    assert [got.n, got["mean"], got.std, got.min, got.p25, got.p50, got.p75, got.max] == (
        pytest.approx(want.tolist())
    )


def test_head_is_ordered(spark):
    df = spark.range(100).repartition(4)
    assert [r.id for r in profiling.head(df, ["id"], 3).collect()] == [0, 1, 2]


def test_describe_of_many_columns(spark):
    rng = np.random.default_rng(5)
    n = 40_000
    columns = {
        "normal": rng.normal(size=n), "constant": np.full(n, 2.5), "few": rng.integers(0, 4, n) * 1.0,
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.exponential(size=n) * 1e6),
    }
    wide = spark.createDataFrame(pd.DataFrame(columns)).withColumn("none", F.lit(None).cast("double"))
    small = spark.createDataFrame([(3,), (None,), (1,), (2,)], "v int")
    empty = spark.createDataFrame([], "v double")
    described = profiling.describe(
        {"wide": wide, "small": small, "empty": empty},
        {"wide": [*columns, "none"], "small": ["v"], "empty": ["v"]},
    )
    got = {(r.table_name, r.column_name): r for r in described.collect()}
    assert len(got) == 7
    for name, values in columns.items():
        row = got["wide", name]
        assert [row.p25, row.p50, row.p75] == pytest.approx(list(np.quantile(values, (0.25, 0.5, 0.75))), rel=1e-12)
        assert row.n == n and row.min == values.min() and row.max == values.max()
    assert (got["small", "v"].n, got["small", "v"].p25, got["small", "v"].p50) == (3, 1.5, 2.0)
    for place in (("wide", "none"), ("empty", "v")):
        assert (got[place].n, got[place].p50, got[place].max) == (0, None, None)
    only = profiling.describe({"empty": empty}, {"empty": ["v"]}).collect()
    assert [(r.n, r.p50) for r in only] == [(0, None)]
    near = profiling.describe({"small": small}, {"small": ["v"]}, approx=True).first()
    assert near.p50 == 2.0
