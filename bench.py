"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of cores. Every query is built
and its whole result is consumed, once to warm up and then ``RUNS`` times; the best time counts.
Model queries train in their warm-up, so ``ml_fit_*`` is timed on its own.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from ledgerlens import testbed
from ledgerlens.models import features, training
from ledgerlens.registry import QUERIES
from tests.session import local_session

RUNS = 2
HEADLINE = (
    "desc_account_mix",
    "desc_card_mix",
    "desc_loan_mix",
    "desc_fraud_by_category",
    "desc_fraud_by_card_type",
    "desc_fraud_by_month",
    "desc_default_by_loan_type",
    "desc_default_by_branch",
    "desc_default_by_tenure",
    "desc_ticket_summary",
    "desc_spend_vs_fraud",
    "desc_segmentation",
    "desc_util_by_card_type",
    "desc_monthly_trend",
    "diag_credit_band_risk",
    "diag_category_disproportion",
    "diag_prior_report",
    "diag_branch_excess",
    "diag_escalation_crosstab",
    "diag_util_fraud",
    "diag_age_status_crosstab",
    "join_txn_card_type",
    "join_txn_reports",
    "prof_describe",
    "profile_cardinality",
    "insight_table_facts",
    "ingest_all",
    "convert_report",
    "ml_stratified_split",
    "ml_auc",
)


def consume(df) -> None:
    """Compute every column of every row, keeping none."""
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def fit_seconds(spark: SparkSession, sf_dir: str, task: features.Task) -> float:
    """Features, split and both models of one task."""
    bank = testbed.bank_on(spark, sf_dir)
    return timed(
        lambda: training.fit(features.FEATURES[task.name](bank, testbed.AS_OF), task).models()
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = local_session(cores, "ledgerlens-bench")
    seconds = {}
    for name in HEADLINE:
        run = lambda name=name: consume(QUERIES[name](spark, sf_dir))
        run()
        seconds[name] = round(min(timed(run) for _ in range(RUNS)), 3)
    for task in features.TASKS:
        seconds[f"ml_fit_{task.name}"] = round(fit_seconds(spark, sf_dir, task), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
