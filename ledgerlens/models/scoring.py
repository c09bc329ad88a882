"""Risk scores of active loans from a fitted late-payment forest."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.bank import Bank
from ledgerlens.functions.scalars import ratio, round_even
from ledgerlens.models.features import LATE, late_frame
from ledgerlens.models.training import for_scoring, predict
from ledgerlens.operators.ranking import top
from ledgerlens.plans.derived import Day
from ledgerlens.schema import ACTIVE_STATUS

# Fixed value: a loan scored above this is a high risk.
HIGH_RISK = 0.5


def active_loans(df: DataFrame) -> DataFrame:
    return df.filter(F.col("STATUS") == ACTIVE_STATUS)


def score_active(bank: Bank, model: PipelineModel, as_of: Day = None) -> DataFrame:
    """Probability of a late payment per active loan; a missing feature counts as 0."""
    active = active_loans(late_frame(bank, as_of))
    numbers = active.select(
        "LOAN_ID", "CUSTOMER_ID", *(F.col(f).cast("double").alias(f) for f in LATE.features)
    ).na.fill(0.0, list(LATE.features))
    # At most one row per active loan.
    numbers = for_scoring(numbers, "LOAN_ID", active_loans(bank["loan"]).count())
    return predict(model, numbers, "LOAN_ID", "CUSTOMER_ID").select(
        "LOAN_ID", "CUSTOMER_ID", F.col("score").alias("late_risk_score")
    )


def riskiest_loans(scored: DataFrame, n: int = 10) -> DataFrame:
    return top(scored, "late_risk_score", n, "LOAN_ID")


def high_risk_share(scored: DataFrame) -> DataFrame:
    """How many active loans are high risks, and their percentage."""
    high = F.count_if(F.col("late_risk_score") > HIGH_RISK)
    total = F.count(F.lit(1))
    return scored.agg(
        high.alias("high_risk_loans"),
        total.alias("active_loans"),
        round_even(ratio(high, total) * 100, 1).alias("high_risk_pct"),
    )
