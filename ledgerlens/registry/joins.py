"""Queries on joins and marks, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlens.models import features
from ledgerlens.operators import joins
from ledgerlens.plans import derived, diagnostic
from ledgerlens.registry.core import Context, query
from ledgerlens.testbed import AS_OF


@query("join_txn_card_type", "select CARD_TXN_ID, CARD_ID, CARD_TYPE from card_txn")
def join_txn_card_type(context: Context) -> DataFrame:
    typed = joins.lookup(context["card_transaction"], context["cards"], "CARD_ID", ["CARD_TYPE"])
    return typed.select("CARD_TXN_ID", "CARD_ID", "CARD_TYPE")


@query("join_loan_ever_late", "select LOAN_ID, ever_late, is_default, tenure_band from loan_full")
def join_loan_ever_late(context: Context) -> DataFrame:
    loans = derived.loan_full(context.bank, AS_OF)
    return loans.select("LOAN_ID", "ever_late", "is_default", "tenure_band")


@query(
    "join_customer_balance",
    """select c.CUSTOMER_ID, c.income_band, c.credit_band, b.BALANCE
      from customers_banded c left join customer_balance b on c.CUSTOMER_ID = b.CUSTOMER_ID""",
)
def join_customer_balance(context: Context) -> DataFrame:
    joined = derived.customers_with_balance(context.bank)
    return joined.select("CUSTOMER_ID", "income_band", "credit_band", "BALANCE")


@query(
    "join_card_spend",
    """select CARD_ID, CARD_TYPE, cast(total_spend as double) as total_spend, utilization_pct
      from card_util""",
)
def join_card_spend(context: Context) -> DataFrame:
    used = derived.card_util(context.bank)
    spend = used["total_spend"].cast("double").alias("total_spend")
    return used.select("CARD_ID", "CARD_TYPE", spend, "utilization_pct")


@query(
    "join_loan_credit_band",
    """select l.LOAN_ID, l.is_default, l.ever_late, c.credit_band
      from loan_full l left join customers_banded c on l.CUSTOMER_ID = c.CUSTOMER_ID""",
)
def join_loan_credit_band(context: Context) -> DataFrame:
    banded = context["customers"].withColumn("credit_band", derived.CREDIT.label("CREDIT_SCORE"))
    loans = derived.loan_full(context.bank, AS_OF)
    joined = joins.lookup(loans, banded, "CUSTOMER_ID", ["credit_band"])
    return joined.select("LOAN_ID", "is_default", "ever_late", "credit_band")


@query("join_txn_customer", "select CARD_TXN_ID, CARD_ID, CUSTOMER_ID from txn_owner")
def join_txn_customer(context: Context) -> DataFrame:
    owned = joins.lookup(context["card_transaction"], context["cards"], "CARD_ID", ["CUSTOMER_ID"])
    return owned.select("CARD_TXN_ID", "CARD_ID", "CUSTOMER_ID")


@query(
    "join_txn_reports",
    """select CARD_TXN_ID, CARD_ID, CUSTOMER_ID, TXN_DATE, IS_FRAUD,
      count(fraud_report_date) as n_reports, count(*) filter (where mark) as n_prior_reports,
      count(*) filter (where mark) > 0 as had_prior_fraud_report
    from txn_report_pairs group by CARD_TXN_ID, CARD_ID, CUSTOMER_ID, TXN_DATE, IS_FRAUD""",
)
def join_txn_reports(context: Context) -> DataFrame:
    return diagnostic.txn_reports(context.bank)


@query(
    "join_loan_network_rate",
    """select l.LOAN_ID, l.LOAN_TYPE, r.network_default_rate
      from loan_full l left join network_rate r on l.LOAN_TYPE = r.LOAN_TYPE""",
)
def join_loan_network_rate(context: Context) -> DataFrame:
    rated = diagnostic.loans_with_network_rate(context.bank, AS_OF)
    return rated.select("LOAN_ID", "LOAN_TYPE", "network_default_rate")


@query(
    "join_branch_name",
    """select l.LOAN_ID, l.BRANCH_ID, b.BRANCH_NAME
      from loan l join branches b on l.BRANCH_ID = b.BRANCH_ID""",
)
def join_branch_name(context: Context) -> DataFrame:
    named = joins.lookup(
        context["loan"], context["branches"], "BRANCH_ID", ["BRANCH_NAME"], "inner"
    )
    return named.select("LOAN_ID", "BRANCH_ID", "BRANCH_NAME")


@query(
    "join_account_customer",
    """select a.ACCOUNT_ID, a.CUSTOMER_ID, a.STATUS
      from accounts a join customers c on a.CUSTOMER_ID = c.CUSTOMER_ID""",
)
def join_account_customer(context: Context) -> DataFrame:
    known = joins.lookup(context["accounts"], context["customers"], "CUSTOMER_ID", [], "inner")
    return known.select("ACCOUNT_ID", "CUSTOMER_ID", "STATUS")


@query(
    "join_loan_customer",
    "select LOAN_ID, CUSTOMER_ID, CREDIT_SCORE, ANNUAL_INCOME, tenure_days from default_frame",
)
def join_loan_customer(context: Context) -> DataFrame:
    joined = features.default_frame(context.bank, AS_OF)
    return joined.select("LOAN_ID", "CUSTOMER_ID", "CREDIT_SCORE", "ANNUAL_INCOME", "tenure_days")


@query(
    "join_loan_paystats",
    """select l.LOAN_ID, coalesce(h.payments_made, 0) as payments_made,
      coalesce(h.late_payments, 0) as late_payments, coalesce(h.late_ratio, 0) as late_ratio
    from loan l left join payment_history h on l.LOAN_ID = h.LOAN_ID""",
)
def join_loan_paystats(context: Context) -> DataFrame:
    joined = features.loans_with_payments(context.bank, AS_OF)
    return joined.select("LOAN_ID", "payments_made", "late_payments", "late_ratio")


@query(
    "join_p3_score",
    "select LOAN_ID, CUSTOMER_ID, CREDIT_SCORE, payments_made, late_ratio from late_frame",
)
def join_p3_score(context: Context) -> DataFrame:
    joined = features.late_frame(context.bank, AS_OF)
    return joined.select("LOAN_ID", "CUSTOMER_ID", "CREDIT_SCORE", "payments_made", "late_ratio")


@query("mark_fraud_on_card", "select CARD_ID, fraud_on_card from card_util")
def mark_fraud_on_card(context: Context) -> DataFrame:
    frauds = context["card_transaction"].filter("IS_FRAUD = 1")
    marked = joins.mark_exists(context["cards"], "CARD_ID", frauds, "fraud_on_card")
    return marked.select("CARD_ID", marked["fraud_on_card"].cast("int").alias("fraud_on_card"))


@query(
    "mark_escalated_customer",
    "select ACCOUNT_ID, CUSTOMER_ID, STATUS, had_escalated_ticket from accounts_marked",
)
def mark_escalated_customer(context: Context) -> DataFrame:
    marked = diagnostic.accounts_marked(context.bank)
    return marked.select("ACCOUNT_ID", "CUSTOMER_ID", "STATUS", "had_escalated_ticket")


@query(
    "join_scalar_baseline",
    """select MERCHANT_CATEGORY, total_txn, fraud_txn, fraud_rate_pct,
      fraud_rate_pct - (select cast(sum(IS_FRAUD) as double) / count(IS_FRAUD) * 100
        from card_transaction) as disproportionate
    from desc_fraud_by_category""",
)
def join_scalar_baseline(context: Context) -> DataFrame:
    return diagnostic.category_minus_baseline(context.bank)
