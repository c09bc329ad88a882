"""Shape of the physical plans: what must never appear, and what must."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerlens import testbed
from ledgerlens.plans import derived, descriptive, diagnostic
from ledgerlens.registry import QUERIES

# Queries that run jobs while they are built (they train models or write files).
EAGER = re.compile(r"^(ml_(lr|rf|predict|feature|model|best|score|high|save)|topk_risk|src_|sink_"
                   r"|cat_create|ingest|convert|pred_prior|mark_escalated|expr_bool)")
LAZY = sorted(n for n in QUERIES if not EAGER.match(n))


def plan_of(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_pairwise_join(name, spark, sf_dir):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for bad in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups",
                "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_quantile_edges_are_planned_once(spark, sf_dir):
    plan = plan_of(QUERIES["desc_segmentation"](spark, sf_dir))
    assert len(plan) < 100_000
    assert plan.count("Subquery:") <= 5


def scans(df):
    """Columns read per scan."""
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*?)>", plan_of(df))]


@pytest.fixture
def bank(spark, sf_dir):
    return testbed.bank_on(spark, sf_dir)


def test_scans_read_only_what_is_used(bank):
    assert scans(descriptive.card_mix(bank)) == [
        {"o_orderkey", "o_totalprice", "o_orderpriority"}
    ]
    assert {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"} in scans(
        descriptive.fraud_by_category(bank)
    )


def test_filters_reach_the_scan(spark, tmp_path, bank):
    path = str(tmp_path / "tickets")
    bank["support_ticket"].write.parquet(path)
    bank._open["support_ticket"] = spark.read.parquet(path)
    plan = plan_of(diagnostic.fraud_reports(bank))
    assert "EqualTo(ISSUE_TYPE,Fraud Report)" in plan
    assert "ReadSchema: struct<CUSTOMER_ID:bigint,ISSUE_TYPE:string,DATE_OPENED:date>" in plan


def test_event_table_is_read_once_for_utilisation(bank):
    assert plan_of(derived.card_util(bank)).count("lineitem.parquet") == 1


def test_facts_are_combined_before_the_join(bank, spark):
    """Without broadcast, what is shuffled for the card join is one row per card."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(descriptive.fraud_by_card_type(bank), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = plan.index("SortMergeJoin")
    below = plan[join:]
    # The join reuses the partitioning of the aggregation: partial sums, one shuffle, final sums.
    assert re.search(r"HashAggregate\(keys=\[CARD_ID.*?Exchange hashpartitioning\(CARD_ID.*?"
                     r"HashAggregate\(keys=\[CARD_ID.*?partial_", below, re.S)


def test_top_rows_need_no_full_sort(bank):
    assert "TakeOrderedAndProject" in plan_of(descriptive.worst_branches(bank, testbed.AS_OF))


def test_nothing_is_broadcast_without_a_size_check(bank, spark):
    """With automatic broadcast off, analyses fall back to shuffled joins."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (
            derived.card_txn(bank), derived.loan_full(bank), diagnostic.branch_excess(bank),
            diagnostic.prior_report(bank), diagnostic.escalation_crosstab(bank),
            diagnostic.credit_band_risk(bank), diagnostic.txn_reports(bank),
        ):
            assert "BroadcastHashJoin" not in plan_of(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


HOT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
}


def test_hot_card_is_split_in_row_level_joins(spark, bank):
    """A third of all transactions on one card: its partition is split, no row is lost."""
    n = 60_000
    hot = spark.range(0, n, 1, 8).select(
        F.col("id").alias("CARD_TXN_ID"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500 + 2).alias("CARD_ID"),
        F.lit("Fuel").alias("MERCHANT_CATEGORY"),
        (F.rand(1) * 1_000_000).cast("decimal(18,2)").alias("AMOUNT"),
        F.lit(testbed.AS_OF).alias("TXN_DATE"),
        F.lit(0).alias("IS_FRAUD"),
    )
    bank._open["card_transaction"] = hot
    bank._open["cards"] = spark.range(1, 502).select(
        F.col("id").alias("CARD_ID"), F.col("id").alias("CUSTOMER_ID"), F.lit("Gold").alias("CARD_TYPE"),
    )
    for key, value in HOT.items():
        spark.conf.set(key, value)
    try:
        joined = derived.card_txn(bank, testbed.AS_OF)
        counts = joined.groupBy("CARD_TYPE").agg(
            F.count(F.lit(1)).alias("n"), F.max("AMOUNT").alias("m")
        )
        assert [(r.CARD_TYPE, r.n) for r in counts.collect()] == [("Gold", n)]
        assert "skew=true" in plan_of(counts, "simple")
        assert descriptive.fraud_by_card_type(bank).first().total_txn == n
    finally:
        for key in HOT:
            spark.conf.unset(key)
