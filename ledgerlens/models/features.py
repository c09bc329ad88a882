"""Feature frames of the three prediction tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.bank import Bank
from ledgerlens.functions.scalars import ratio
from ledgerlens.operators.joins import lookup
from ledgerlens.operators.sampling import class_sizes
from ledgerlens.plans import derived
from ledgerlens.plans.derived import Day


@dataclass(frozen=True)
class Task:
    """What is predicted from what. Features and forest size.

    ``max_rows`` is for callers with little memory; no task below has it.
    """

    name: str
    key: str
    features: tuple[str, ...]
    label: str
    trees: int
    depth: int
    text_features: tuple[str, ...] = ()
    max_rows: int | None = None

    def encoded(self) -> list[str]:
        """Feature columns after text has become codes."""
        return [f + "_code" if f in self.text_features else f for f in self.features]


FRAUD = Task(
    "fraud",
    "CARD_TXN_ID",
    ("AMOUNT", "CARD_TYPE", "MERCHANT_CATEGORY", "days_since_txn"),
    "IS_FRAUD",
    trees=100,
    depth=5,
    text_features=("CARD_TYPE", "MERCHANT_CATEGORY"),
)
DEFAULT = Task(
    "default",
    "LOAN_ID",
    ("ANNUAL_INCOME", "CREDIT_SCORE", "tenure_days", "LOAN_AMOUNT", "INTEREST_RATE", "ever_late"),
    "is_default",
    trees=200,
    depth=6,
)
LATE = Task(
    "late",
    "LOAN_ID",
    ("CREDIT_SCORE", "LOAN_AMOUNT", "INTEREST_RATE", "payments_made", "late_ratio"),
    "ever_late",
    trees=200,
    depth=6,
)
TASKS = (FRAUD, DEFAULT, LATE)


def complete(df: DataFrame, task: Task) -> DataFrame:
    """Key, features and label of the rows that lack none of them; decimals become doubles."""
    kinds = dict(df.dtypes)
    columns = [
        F.col(c).cast("double").alias(c) if kinds[c].startswith("decimal") else F.col(c)
        for c in (task.key, *task.features, task.label)
    ]
    return df.select(*columns).na.drop(subset=[*task.features, task.label])


def fraud_features(bank: Bank, as_of: Day = None) -> DataFrame:
    return complete(derived.card_txn(bank, as_of), FRAUD)


def default_frame(bank: Bank, as_of: Day = None) -> DataFrame:
    loans = lookup(
        derived.loan_full(bank, as_of),
        bank["customers"],
        "CUSTOMER_ID",
        ["CREDIT_SCORE", "ANNUAL_INCOME"],
        "inner",
    )
    return loans.na.fill(0, ["tenure_days"])


def default_features(bank: Bank, as_of: Day = None) -> DataFrame:
    return complete(default_frame(bank, as_of), DEFAULT)


def loans_with_payments(bank: Bank, as_of: Day = None) -> DataFrame:
    """Loans with payment history; a loan without payments has zeros."""
    loans = bank["loan"].join(derived.payment_history(bank), "LOAN_ID", "left")
    return derived.with_loan_marks(loans, as_of).na.fill(
        0, ["payments_made", "late_payments", "late_ratio"]
    )


def late_frame(bank: Bank, as_of: Day = None) -> DataFrame:
    """Loans with payment history and credit score.

    The label ``ever_late`` is 1 exactly when the feature ``late_ratio`` is positive: the task is
    defined that way, so its models are near perfect by construction.
    """
    return lookup(
        loans_with_payments(bank, as_of), bank["customers"], "CUSTOMER_ID", ["CREDIT_SCORE"],
        "inner",
    )


def late_features(bank: Bank, as_of: Day = None) -> DataFrame:
    return complete(late_frame(bank, as_of), LATE)


FEATURES = {"fraud": fraud_features, "default": default_features, "late": late_features}


def class_check(df: DataFrame, label: str) -> DataFrame:
    """How many classes the label has and whether a model can be trained on it."""
    return df.agg(F.count_distinct(label).alias("n_classes")).withColumn(
        "trainable", F.col("n_classes") >= 2
    )


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class: rows and the weight rows / (classes * class rows); one row per class."""
    sizes = class_sizes(df, label)
    classes = F.count(F.lit(1)).over(W.partitionBy("all_rows"))
    return sizes.select(
        label, "class_rows", ratio(F.col("all_rows"), classes * F.col("class_rows")).alias("weight")
    )


def scaling(train: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of every column over the training rows, one row each."""
    wide = train.agg(
        *(
            F.struct(
                F.avg(F.col(c).cast("double")).alias("mean"),
                F.stddev_pop(F.col(c).cast("double")).alias("std"),
            ).alias(c)
            for c in columns
        )
    )
    return wide.unpivot([], columns, "feature", "s").select(
        "feature", F.col("s.mean").alias("mean"), F.col("s.std").alias("std")
    )
