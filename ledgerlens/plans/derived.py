"""Tables derived from the bank tables. Each is a lazy plan; ``as_of`` fixes "today"."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.bank import Bank
from ledgerlens.functions.bands import (
    ACCOUNT_AGE,
    CREDIT,
    TENURE,
    UTILIZATION,
    with_quartile_band,
)
from ledgerlens.functions.scalars import (
    as_of_date,
    elapsed_days,
    is_in,
    mean,
    month_of,
    ratio,
    sum_or_zero,
    utilization_pct,
)
from ledgerlens.operators.joins import lookup
from ledgerlens.schema import DEFAULT_STATUSES

Day = dt.date | None


def present(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose grouping keys are all known; groups without a key are no groups."""
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df


def card_txn(bank: Bank, as_of: Day = None) -> DataFrame:
    """Card transactions with card type, month and age in days."""
    typed = lookup(bank["card_transaction"], bank["cards"], "CARD_ID", ["CARD_TYPE"])
    return typed.withColumns(
        {
            "txn_month": month_of("TXN_DATE"),
            "days_since_txn": elapsed_days(typed, as_of_date(as_of), "TXN_DATE"),
        }
    )


def card_totals(bank: Bank) -> DataFrame:
    """One row per card that has transactions: counts, frauds, spend, any fraud.

    A card with very many transactions is combined before the shuffle and reaches later joins as
    one row.
    """
    return (
        present(bank["card_transaction"], "CARD_ID")
        .groupBy("CARD_ID")
        .agg(
            F.count("CARD_TXN_ID").alias("total_txn"),
            sum_or_zero("IS_FRAUD").alias("fraud_txn"),
            sum_or_zero("AMOUNT").alias("total_spend"),
            F.max((F.col("IS_FRAUD") == 1).cast("int")).alias("any_fraud"),
        )
    )


def payment_history(bank: Bank) -> DataFrame:
    """Everything the payments say about a loan, from one aggregation."""
    history = (
        present(bank["loan_payment"], "LOAN_ID")
        .groupBy("LOAN_ID")
        .agg(
            F.max("LATE_PAYMENT_FLAG").alias("ever_late"),
            F.count("PAYMENT_ID").alias("payments_made"),
            sum_or_zero("LATE_PAYMENT_FLAG").alias("late_payments"),
        )
    )
    return history.withColumn("late_ratio", ratio("late_payments", "payments_made"))


def ever_late(bank: Bank) -> DataFrame:
    """1 for a loan with any late payment."""
    return payment_history(bank).select("LOAN_ID", "ever_late")


def pay_stats(bank: Bank) -> DataFrame:
    """Payments, late payments and their ratio per loan."""
    return payment_history(bank).select("LOAN_ID", "payments_made", "late_payments", "late_ratio")


def with_loan_marks(loans: DataFrame, as_of: Day = None) -> DataFrame:
    """Default flag, tenure and tenure band of a frame that already has ``ever_late``."""
    tenure = elapsed_days(loans, as_of_date(as_of), "START_DATE")
    return (
        loans.withColumns(
            {
                "ever_late": F.coalesce("ever_late", F.lit(0)),
                "is_default": is_in("STATUS", DEFAULT_STATUSES),
                "tenure_days": tenure,
            }
        ).withColumn("tenure_band", TENURE.label("tenure_days"))
    )


def loan_full(bank: Bank, as_of: Day = None) -> DataFrame:
    """Loans with late flag, default flag, tenure and tenure band."""
    return with_loan_marks(bank["loan"].join(ever_late(bank), "LOAN_ID", "left"), as_of)


def customers_banded(bank: Bank, approx: bool = False) -> DataFrame:
    """Customers with income quartile and credit band."""
    banded = with_quartile_band(bank["customers"], "ANNUAL_INCOME", "income_band", approx)
    return banded.withColumn("credit_band", CREDIT.label("CREDIT_SCORE"))


def customer_balance(bank: Bank) -> DataFrame:
    """Mean account balance per customer."""
    return (
        present(bank["accounts"], "CUSTOMER_ID")
        .groupBy("CUSTOMER_ID")
        .agg(mean("BALANCE").alias("BALANCE"))
    )


def customers_with_balance(bank: Bank, approx: bool = False) -> DataFrame:
    return customers_banded(bank, approx).join(customer_balance(bank), "CUSTOMER_ID", "left")


def card_util(bank: Bank) -> DataFrame:
    """Cards with spend, utilisation, utilisation band and fraud mark.

    Spend and fraud mark come out of one aggregation, so the event table is read once.
    """
    return cards_used(
        bank["cards"], card_totals(bank).select("CARD_ID", "total_spend", "any_fraud")
    )


def cards_used(cards: DataFrame, totals: DataFrame) -> DataFrame:
    """Cards with utilisation, its band and a fraud mark, from ``totals`` of one row per card."""
    spent = cards.join(totals, "CARD_ID", "left").withColumns(
        {
            "total_spend": F.coalesce("total_spend", F.lit(0)),
            "fraud_on_card": F.coalesce("any_fraud", F.lit(0)),
        }
    ).drop("any_fraud")
    used = spent.withColumn("utilization_pct", utilization_pct("total_spend", "CREDIT_LIMIT"))
    return used.withColumn("util_band", UTILIZATION.label("utilization_pct"))


def transactions(bank: Bank) -> DataFrame:
    return bank["transaction_list"].withColumn("txn_month", month_of("TXN_DATE"))


def tickets(bank: Bank) -> DataFrame:
    opened = bank["support_ticket"]
    return opened.withColumn(
        "resolution_days", elapsed_days(opened, "DATE_RESOLVED", "DATE_OPENED")
    )


def accounts_aged(bank: Bank, as_of: Day = None) -> DataFrame:
    accounts = bank["accounts"]
    age = elapsed_days(accounts, as_of_date(as_of), "OPEN_DATE")
    return accounts.withColumn("account_age_days", age).withColumn(
        "account_age_band", ACCOUNT_AGE.label("account_age_days")
    )


def branches(bank: Bank) -> DataFrame:
    return bank["branches"]


def build_derived(bank: Bank, as_of: Day = None) -> dict[str, DataFrame]:
    """All derived tables by name. Nothing runs until one of them is used."""
    return {
        "card_txn": card_txn(bank, as_of),
        "loan_full": loan_full(bank, as_of),
        "customers": customers_banded(bank),
        "customers_with_balance": customers_with_balance(bank),
        "card_util": card_util(bank),
        "transaction_list": transactions(bank),
        "support_ticket": tickets(bank),
        "accounts": accounts_aged(bank, as_of),
        "branches": branches(bank),
    }
