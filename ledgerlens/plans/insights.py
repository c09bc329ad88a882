"""Facts and sentences of every analysis, built from its leading rows.

All of them roll up from the shared cells, so that each event table is read once. Every piece is a
frame of a few rows, so the union is a short table however large the bank is, and nothing is
collected to build the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.bank import Bank
from ledgerlens.functions.scalars import round_even
from ledgerlens.operators.ranking import leading_key, top
from ledgerlens.plans import diagnostic
from ledgerlens.plans.cells import Cells
from ledgerlens.plans.derived import Day


def _leaders(bank: Bank, as_of: Day) -> list[tuple[str, DataFrame, Column, Column, Column]]:
    """(analysis, leading rows, key, value, sentence) of every analysis that has an insight."""
    c = F.col
    money = lambda name: F.format_number(c(name), 0)
    cells = Cells(bank, as_of).build()
    accounts = top(cells.account_mix(), "accounts", 1, "ACCOUNT_TYPE", "STATUS")
    loans = top(cells.loan_types(), "total_disbursed", 1, "LOAN_TYPE")
    spend = cells.categories()
    category = top(spend, "fraud_rate_pct", 1, "MERCHANT_CATEGORY")
    types = cells.card_types()
    card_type = top(types.filter("total_txn is not null"), "fraud_rate_pct", 1, "CARD_TYPE")
    loan_type = top(cells.loan_types(), "default_rate_pct", 1, "LOAN_TYPE")
    issues = cells.issues()
    segment = top(cells.segments(), "avg_balance", 1, "income_band", "credit_band")
    util = top(types, "utilization_pct", 1, "CARD_TYPE")
    credit = cells.credit_bands()
    above = cells.positive_excess()
    band = leading_key(cells.util_bands(), "util_band", "fraud_rate_pct")
    shares = diagnostic.escalation_shares(cells.escalation, by="column")
    text = F.format_string
    return [
        (
            "account_mix", accounts,
            F.concat_ws("/", "ACCOUNT_TYPE", "STATUS"), c("total_balance"),
            text("Most accounts are %s/%s, with a balance of %s in all.",
                 "ACCOUNT_TYPE", "STATUS", money("total_balance")),
        ),
        (
            "loan_mix", loans, c("LOAN_TYPE"), c("total_disbursed"),
            text("The largest loan book is %s: %s paid out at %.2f%% on average.",
                 "LOAN_TYPE", money("total_disbursed"), "avg_interest_rate"),
        ),
        (
            "fraud_by_category", category, c("MERCHANT_CATEGORY"), c("fraud_rate_pct"),
            text("Fraud is most frequent in %s (%.2f%% of transactions).",
                 "MERCHANT_CATEGORY", "fraud_rate_pct"),
        ),
        (
            "fraud_by_card_type", card_type, c("CARD_TYPE"), c("fraud_rate_pct"),
            text("Among card types, %s has the highest fraud rate (%.2f%%).",
                 "CARD_TYPE", "fraud_rate_pct"),
        ),
        (
            "default_by_loan_type", loan_type, c("LOAN_TYPE"), c("default_rate_pct"),
            text("%s loans default most often (%.2f%%); %.2f%% of them were ever paid late.",
                 "LOAN_TYPE", "default_rate_pct", "late_rate_pct"),
        ),
        (
            "most_tickets", top(issues, "tickets", 1, "ISSUE_TYPE"),
            c("ISSUE_TYPE"), c("tickets").cast("double"),
            text("%s causes the most tickets (%d).", "ISSUE_TYPE", "tickets"),
        ),
        (
            "slowest_tickets", top(issues, "avg_resolution_days", 1, "ISSUE_TYPE"),
            c("ISSUE_TYPE"), c("avg_resolution_days"),
            text("%s takes longest to resolve (%.1f days).", "ISSUE_TYPE", "avg_resolution_days"),
        ),
        (
            "top_spend", top(spend, "total_spend", 1, "MERCHANT_CATEGORY"),
            c("MERCHANT_CATEGORY"), c("total_spend"),
            text("Most is spent on %s (%s).", "MERCHANT_CATEGORY", money("total_spend")),
        ),
        (
            "segmentation", segment,
            F.concat_ws("/", "income_band", "credit_band"), round_even(c("avg_balance"), 4),
            text("The best balance (%s) is held in income band %s, credit band %s.",
                 money("avg_balance"), "income_band", "credit_band"),
        ),
        (
            "utilization", util, c("CARD_TYPE"), c("utilization_pct"),
            text("%s cards use most of their limit (%.2f%%): review limits or offers.",
                 "CARD_TYPE", "utilization_pct"),
        ),
        (
            "credit_band_default", top(credit, "defaults_rate_pct", 1, "credit_band"),
            c("credit_band"), c("defaults_rate_pct"),
            text("Credit band %s defaults most often (%.2f%%).",
                 "credit_band", "defaults_rate_pct"),
        ),
        (
            "credit_band_late", top(credit, "late_rate_pct", 1, "credit_band"),
            c("credit_band"), c("late_rate_pct"),
            text("Credit band %s pays late most often (%.2f%%).", "credit_band", "late_rate_pct"),
        ),
        (
            "report_lift", cells.report_lift().filter(c("lift").isNotNull()),
            c("verdict"), round_even(c("lift")),
            text("Fraud rate %.2f%% after a report of the customer, %.2f%% otherwise"
                 " (%+.2f points): %s.", "rate_with", "rate_without", "lift", "verdict"),
        ),
        (
            "branches_above_expected",
            above.agg(
                F.count(F.lit(1)).alias("n"),
                # The worst branch; the smaller id on a tie.
                F.min_by(
                    "BRANCH_NAME", F.struct(-c("excess_default_pct"), c("BRANCH_ID"))
                ).alias("name"),
                F.max("excess_default_pct").alias("excess"),
            ).filter("n > 0"),
            c("name"), c("n").cast("double"),
            text("%d branches default more than their loan mix explains; %s most (%+.2f points).",
                 "n", "name", "excess"),
        ),
        (
            "escalation_risk",
            diagnostic.risk_of(cells.escalation).filter(c("escalated_risk_pct").isNotNull()),
            c("verdict"), round_even(c("escalated_risk_pct"), 4),
            text("%.1f%% of accounts of customers with escalated tickets are dormant or closed,"
                 " %.1f%% of the others: %s.", "escalated_risk_pct", "other_risk_pct", "verdict"),
        ),
        (
            "util_band_fraud", band, c("util_band"), c("fraud_rate_pct"),
            text("Cards in utilisation band %s see fraud most often (%.2f%%).",
                 "util_band", "fraud_rate_pct"),
        ),
        (
            "escalated_share", shares, c("STATUS"), c("escalated_pct"),
            text("%.1f%% of accounts of customers with escalated tickets are %s, %.1f%% of the others.",
                 "escalated_pct", "STATUS", "not_escalated_pct"),
        ),
        (
            "age_status", cells.age_leaders(),
            F.concat_ws("/", "account_age_band", "STATUS"), c("pct"),
            text("Accounts aged %s are mostly %s (%.2f%%).", "account_age_band", "STATUS", "pct"),
        ),
    ]


def model_sentences(best: DataFrame, importance: DataFrame) -> DataFrame:
    """(analysis, sentence): the best model of each task, and the strongest driver of its forest.

    ``best`` is that of ``evaluation.best_model`` per task, ``importance`` the forests' importances
    of all tasks; both have a few rows per task.
    """
    lead = F.struct((-F.col("importance")).alias("_i"), F.col("feature").alias("_f"))
    strongest = importance.groupBy("task").agg(F.min(lead).alias("_lead"))
    rows = best.join(strongest, "task")
    sentence = F.format_string(
        "%s performs best on the %s task (ROC-AUC %.3f); %s is the strongest driver,"
        " with %.1f%% of the forest's decision weight.",
        "best_model", "task", "roc_auc", "_lead._f", -F.col("_lead._i") * 100,
    )
    analysis = F.concat(F.lit("model_"), "task").alias("analysis")
    return rows.select(analysis, sentence.alias("sentence"))


def facts(bank: Bank, as_of: Day = None) -> DataFrame:
    """(analysis, key, value) of every leading row."""
    return reduce(
        DataFrame.unionByName,
        [
            row.select(F.lit(name).alias("analysis"), key.alias("key"), value.alias("value"))
            for name, row, key, value, _ in _leaders(bank, as_of)
        ],
    )


def sentences(bank: Bank, as_of: Day = None) -> DataFrame:
    """(analysis, sentence) of every leading row."""
    return reduce(
        DataFrame.unionByName,
        [
            row.select(F.lit(name).alias("analysis"), text.alias("sentence"))
            for name, row, _, _, text in _leaders(bank, as_of)
        ],
    )
