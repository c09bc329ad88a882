"""What happened: portfolio mix, fraud, defaults, tickets, segments, utilisation, trend.

Facts are aggregated as far as they can be before they meet a lookup table, so that what is
shuffled for the join is one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.bank import Bank
from ledgerlens.functions.bands import CREDIT, QUARTILE_LABELS, TENURE, Bands
from ledgerlens.functions.scalars import (
    mean,
    mean_pct,
    month_of,
    pct,
    round_even,
    sum_or_zero,
)
from ledgerlens.operators.ranking import order_desc, top
from ledgerlens.plans import derived
from ledgerlens.plans.derived import Day, present

INCOME = Bands((0, 1, 2, 3, 4), QUARTILE_LABELS)


def mix(df: DataFrame, keys: list[str], key: str, count: str, total: tuple, average: tuple):
    """Rows, a total and a mean per group; ``total`` and ``average`` are (column, name)."""
    return (
        present(df, *keys)
        .groupBy(*keys)
        .agg(
            F.count(key).alias(count),
            *([sum_or_zero(total[0]).cast("double").alias(total[1])]),
            mean(average[0]).alias(average[1]),
        )
    )


def account_mix(bank: Bank) -> DataFrame:
    by = ["ACCOUNT_TYPE", "STATUS"]
    mixed = mix(
        bank["accounts"], by, "ACCOUNT_ID", "accounts",
        ("BALANCE", "total_balance"), ("BALANCE", "avg_balance"),
    )
    return order_desc(mixed, "accounts", *by)


def account_share(bank: Bank) -> DataFrame:
    """Share of each account type; the window runs over one row per type."""
    types = (
        present(bank["accounts"], "ACCOUNT_TYPE", "STATUS")
        .groupBy("ACCOUNT_TYPE")
        .agg(F.count("ACCOUNT_ID").alias("accounts"))
    )
    share = pct(F.col("accounts"), F.sum("accounts").over(W.partitionBy()))
    return order_desc(types.withColumn("share_pct", share), "accounts", "ACCOUNT_TYPE")


def card_mix(bank: Bank) -> DataFrame:
    mixed = mix(
        bank["cards"], ["CARD_TYPE"], "CARD_ID", "cards",
        ("CREDIT_LIMIT", "total_credit_balance"), ("CREDIT_LIMIT", "avg_credit_balance"),
    )
    return order_desc(mixed, "total_credit_balance", "CARD_TYPE")


def loan_mix(bank: Bank) -> DataFrame:
    mixed = mix(
        bank["loan"], ["LOAN_TYPE"], "LOAN_ID", "loans",
        ("LOAN_AMOUNT", "total_disbursed"), ("INTEREST_RATE", "avg_interest_rate"),
    )
    return order_desc(mixed, "total_disbursed", "LOAN_TYPE")


def fraud_rates(df: DataFrame, key: str) -> DataFrame:
    """Transactions, frauds and fraud rate per value of ``key``, from raw transactions."""
    groups = present(df, key).groupBy(key).agg(
        F.count("CARD_TXN_ID").alias("total_txn"), sum_or_zero("IS_FRAUD").alias("fraud_txn")
    )
    return groups.withColumn("fraud_rate_pct", pct("fraud_txn", "total_txn"))


def fraud_by_category(bank: Bank) -> DataFrame:
    rates = fraud_rates(bank["card_transaction"], "MERCHANT_CATEGORY")
    return order_desc(rates, "fraud_rate_pct", "MERCHANT_CATEGORY")


def fraud_by_card_type(bank: Bank) -> DataFrame:
    """The same per card type; transactions are added up per card before the join."""
    per_card = derived.card_totals(bank).select("CARD_ID", "total_txn", "fraud_txn")
    typed = present(bank["cards"].select("CARD_ID", "CARD_TYPE"), "CARD_TYPE")
    groups = per_card.join(typed, "CARD_ID").groupBy("CARD_TYPE").agg(
        F.sum("total_txn").alias("total_txn"), F.sum("fraud_txn").alias("fraud_txn")
    )
    rates = groups.withColumn("fraud_rate_pct", pct("fraud_txn", "total_txn"))
    return order_desc(rates, "fraud_rate_pct", "CARD_TYPE")


def fraud_by_month(bank: Bank) -> DataFrame:
    monthly = bank["card_transaction"].withColumn("txn_month", month_of("TXN_DATE"))
    return fraud_rates(monthly, "txn_month").orderBy("txn_month")


def default_rates(loans: DataFrame, key: str) -> DataFrame:
    """Loans, default rate and late rate per value of ``key``."""
    return (
        present(loans, key)
        .groupBy(key)
        .agg(
            F.count("LOAN_ID").alias("loans"),
            mean_pct("is_default").alias("default_rate_pct"),
            mean_pct("ever_late").alias("late_rate_pct"),
        )
    )


def default_by_loan_type(bank: Bank, as_of: Day = None) -> DataFrame:
    rates = default_rates(derived.loan_full(bank, as_of), "LOAN_TYPE")
    return order_desc(rates, "default_rate_pct", "LOAN_TYPE")


def default_by_branch(bank: Bank, as_of: Day = None) -> DataFrame:
    return default_rates(derived.loan_full(bank, as_of), "BRANCH_ID")


def worst_branches(bank: Bank, as_of: Day = None, n: int = 10) -> DataFrame:
    return top(default_by_branch(bank, as_of), "default_rate_pct", n, "BRANCH_ID")


def default_by_tenure(bank: Bank, as_of: Day = None) -> DataFrame:
    rates = default_rates(derived.loan_full(bank, as_of), "tenure_band")
    return rates.orderBy(TENURE.position("tenure_band"))


def ticket_summary(bank: Bank) -> DataFrame:
    summary = (
        present(derived.tickets(bank), "ISSUE_TYPE")
        .groupBy("ISSUE_TYPE")
        .agg(
            F.count("TICKET_ID").alias("tickets"),
            mean("resolution_days").alias("avg_resolution_days"),
        )
    )
    return order_desc(summary, "tickets", "ISSUE_TYPE")


def spend_vs_fraud(bank: Bank) -> DataFrame:
    spend = (
        present(bank["card_transaction"], "MERCHANT_CATEGORY")
        .groupBy("MERCHANT_CATEGORY")
        .agg(
            sum_or_zero("AMOUNT").cast("double").alias("total_spend"),
            F.count("CARD_TXN_ID").alias("total_txn"),
            mean_pct("IS_FRAUD").alias("fraud_rate_pct"),
        )
    )
    return order_desc(spend, "total_spend", "MERCHANT_CATEGORY")


def segmentation(bank: Bank, approx: bool = False) -> DataFrame:
    """Customers and mean of their mean balances per income and credit band, in band order."""
    return segments(derived.customers_banded(bank, approx), derived.customer_balance(bank))


def segments(customers: DataFrame, balances: DataFrame) -> DataFrame:
    """The same from banded customers and ``balances`` of one row per customer."""
    found = (
        present(customers.join(balances, "CUSTOMER_ID", "left"), "income_band", "credit_band")
        .groupBy("income_band", "credit_band")
        .agg(
            F.count("CUSTOMER_ID").alias("customers"),
            F.avg("BALANCE").alias("avg_balance"),
        )
    )
    return found.orderBy(INCOME.position("income_band"), CREDIT.position("credit_band"))


def segmentation_matrix(bank: Bank, approx: bool = False) -> DataFrame:
    """Mean balance as an income band by credit band matrix."""
    return (
        segmentation(bank, approx).groupBy("income_band")
        .pivot("credit_band", list(CREDIT.labels))
        .agg(F.first("avg_balance"))
        .orderBy(INCOME.position("income_band"))
    )


def util_by_card_type(bank: Bank) -> DataFrame:
    # Utilisation has two decimals, so it can be added up exactly.
    exact = F.col("utilization_pct").cast("decimal(28,2)")
    rates = (
        present(derived.card_util(bank), "CARD_TYPE")
        .groupBy("CARD_TYPE")
        .agg(round_even(mean(exact)).alias("utilization_pct"))
    )
    return order_desc(rates, "utilization_pct", "CARD_TYPE")


def monthly_trend(bank: Bank) -> DataFrame:
    return (
        derived.transactions(bank)
        .groupBy("txn_month")
        .agg(
            F.count("TRANSACTION_ID").alias("txn_count"),
            sum_or_zero("AMOUNT").cast("double").alias("total_amount"),
        )
        .orderBy("txn_month")
    )
