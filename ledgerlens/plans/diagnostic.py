"""Why it happened: credit bands, merchant mix, prior reports, branches, escalation, age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.bank import Bank
from ledgerlens.functions.bands import ACCOUNT_AGE, CREDIT, UTILIZATION
from ledgerlens.functions.scalars import (
    at_or_after,
    mean,
    mean_pct,
    normalized,
    not_in,
    pct,
    ratio,
    round_even,
    sum_or_zero,
)
from ledgerlens.operators import crosstab
from ledgerlens.operators.joins import (
    lookup,
    mark_exists,
    minus_baseline,
    pairs_with_prior,
    pairs_without_prior,
    report_history,
)
from ledgerlens.operators.ranking import leading_key, leading_per_group, order_desc, top_by_size
from ledgerlens.operators.skew import salted_lookup
from ledgerlens.plans import derived, descriptive
from ledgerlens.plans.derived import Day, present
from ledgerlens.schema import (
    ACCOUNT_STATUSES,
    DEFAULT_STATUSES,
    FRAUD_REPORT_ISSUE,
    RISK_STATUSES,
    SETTLED_TICKET_STATUSES,
)

# Verdicts of the lift and the escalation comparison.
PREDICTOR, NO_LINK = "strong predictor", "no link"
LINKED = "linked"


def credit_band_risk(bank: Bank, as_of: Day = None) -> DataFrame:
    """Default and late rate per credit band; loans are added up per customer before the join."""
    per_customer = (
        present(derived.loan_full(bank, as_of), "CUSTOMER_ID")
        .groupBy("CUSTOMER_ID")
        .agg(
            F.count("LOAN_ID").alias("loans"),
            F.sum("is_default").alias("defaults"),
            F.sum("ever_late").alias("late"),
        )
    )
    return credit_band_rates(per_customer, bank["customers"])


def credit_band_rates(per_customer: DataFrame, customers: DataFrame) -> DataFrame:
    """The same from ``loans, defaults, late`` of one row per customer."""
    banded = customers.select(
        "CUSTOMER_ID", CREDIT.label("CREDIT_SCORE").alias("credit_band")
    )
    return (
        per_customer.join(present(banded, "credit_band"), "CUSTOMER_ID")
        .groupBy("credit_band")
        .agg(
            pct(F.sum("defaults"), F.sum("loans")).alias("defaults_rate_pct"),
            pct(F.sum("late"), F.sum("loans")).alias("late_rate_pct"),
            F.sum("loans").alias("loans"),
        )
        .select("credit_band", "loans", "defaults_rate_pct", "late_rate_pct")
        .orderBy(CREDIT.position("credit_band"))
    )


def overall_fraud_rate(bank: Bank) -> DataFrame:
    return bank["card_transaction"].agg((mean("IS_FRAUD") * 100).alias("overall_fraud_rate"))


def category_disproportion(bank: Bank) -> DataFrame:
    """Rounded category rate minus the unrounded overall rate.

    The overall rate is added up over the category rows, so the event table is read once. The
    window runs over one row per category; transactions without a category count in it only.
    """
    groups = bank["card_transaction"].groupBy("MERCHANT_CATEGORY").agg(
        F.count("CARD_TXN_ID").alias("total_txn"),
        sum_or_zero("IS_FRAUD").alias("fraud_txn"),
        F.count("IS_FRAUD").alias("_flagged"),
    )
    everything = W.partitionBy()
    overall = ratio(F.sum("fraud_txn").over(everything), F.sum("_flagged").over(everything)) * 100
    rate = pct("fraud_txn", "total_txn")
    gaps = present(groups.withColumn("_overall", overall), "MERCHANT_CATEGORY").select(
        "MERCHANT_CATEGORY",
        "total_txn",
        "fraud_txn",
        rate.alias("fraud_rate_pct"),
        (rate - F.col("_overall")).alias("disproportionate"),
    )
    return order_desc(gaps, "disproportionate", "MERCHANT_CATEGORY")


def category_minus_baseline(bank: Bank) -> DataFrame:
    """The same gap with the overall rate as a scalar subquery, for any frame of rates."""
    rates = descriptive.fraud_rates(bank["card_transaction"], "MERCHANT_CATEGORY")
    return minus_baseline(rates, "fraud_rate_pct", overall_fraud_rate(bank), "disproportionate")


def fraud_reports(bank: Bank) -> DataFrame:
    """Fraud-report tickets as (customer, report date), one row per report."""
    return bank["support_ticket"].filter(F.col("ISSUE_TYPE") == FRAUD_REPORT_ISSUE).select(
        "CUSTOMER_ID", F.col("DATE_OPENED").alias("fraud_report_date")
    )


def first_reports(bank: Bank) -> DataFrame:
    """The first fraud report of every customer that made one."""
    return present(fraud_reports(bank), "CUSTOMER_ID").groupBy("CUSTOMER_ID").agg(
        F.min("fraud_report_date").alias("first_report")
    )


def txn_after_report(bank: Bank) -> DataFrame:
    """Card transactions marked by whether any report of the customer came first.

    Only the first report decides, so the pairs of transactions and reports are not needed.
    """
    owners = salted_lookup(
        bank["cards"].select("CARD_ID", "CUSTOMER_ID"), first_reports(bank), "CUSTOMER_ID",
        ["first_report"],
    )
    owned = lookup(bank["card_transaction"], owners, "CARD_ID", ["first_report"])
    return owned.withColumn("had_prior_fraud_report", at_or_after("TXN_DATE", "first_report"))


def customer_days(bank: Bank) -> DataFrame:
    """Card transactions added up per customer and day."""
    per_card = (
        bank["card_transaction"]
        .groupBy("CARD_ID", "TXN_DATE")
        .agg(
            F.count("CARD_TXN_ID").alias("n_txn"),
            sum_or_zero("IS_FRAUD").alias("n_fraud"),
            F.count("IS_FRAUD").alias("n_flagged"),
        )
    )
    owned = lookup(per_card, bank["cards"], "CARD_ID", ["CUSTOMER_ID"])
    return owned.groupBy("CUSTOMER_ID", "TXN_DATE").agg(
        *(F.sum(c).alias(c) for c in ("n_txn", "n_fraud", "n_flagged"))
    )


def txn_reports(bank: Bank) -> DataFrame:
    """Every card transaction with the number of reports of its customer, and of prior ones.

    This is the join of transactions with reports in counted form: a transaction stands for
    ``max(n_reports, 1)`` rows of that join, ``n_prior_reports`` of which have the mark.
    """
    owned = lookup(bank["card_transaction"], bank["cards"], "CARD_ID", ["CUSTOMER_ID"])
    card_days = bank["card_transaction"].select("CARD_ID", "TXN_DATE").distinct()
    days = (
        lookup(card_days, bank["cards"], "CARD_ID", ["CUSTOMER_ID"])
        .select("CUSTOMER_ID", "TXN_DATE")
        .distinct()
    )
    history = report_history(
        days, fraud_reports(bank), "CUSTOMER_ID", "TXN_DATE", "fraud_report_date"
    )
    # Null customers and null dates are groups of the history as well.
    t, h = owned.alias("t"), history.alias("h")
    same = F.col("t.CUSTOMER_ID").eqNullSafe(F.col("h.CUSTOMER_ID")) & F.col(
        "t.TXN_DATE"
    ).eqNullSafe(F.col("h.TXN_DATE"))
    return t.join(h, same, "left").select(
        "t.CARD_TXN_ID",
        "t.CARD_ID",
        "t.CUSTOMER_ID",
        "t.TXN_DATE",
        "t.IS_FRAUD",
        "h.n_reports",
        "h.n_prior_reports",
        (F.col("h.n_prior_reports") > 0).alias("had_prior_fraud_report"),
    )


def prior_report(bank: Bank, dedupe: bool = False) -> DataFrame:
    """Fraud rate of transactions with and without a prior report of the customer.

    By default a transaction counts once per report of its customer. With ``dedupe`` it counts
    once, as having a prior report when any of them came first.
    """
    return prior_rates(customer_days(bank), fraud_reports(bank), dedupe)


def prior_rates(
    days: DataFrame, reports: DataFrame, dedupe: bool = False, count: str | None = None
) -> DataFrame:
    """The same from transactions per customer and day; ``count`` names the reports of a row."""
    history = report_history(
        days, reports, "CUSTOMER_ID", "TXN_DATE", "fraud_report_date", count
    )
    if dedupe:
        prior = (F.col("n_prior_reports") > 0).cast("bigint")
        weights = {True: prior, False: 1 - prior}
    else:
        weights = {True: pairs_with_prior(), False: pairs_without_prior()}
    sides = F.explode(
        F.array(
            *(
                F.struct(F.lit(mark).alias("had_prior_fraud_report"), weight.alias("weight"))
                for mark, weight in weights.items()
            )
        )
    )
    measures = ("n_txn", "n_fraud", "n_flagged")
    return (
        history.select(sides.alias("side"), *measures)
        .filter(F.col("side.weight") > 0)
        .groupBy(F.col("side.had_prior_fraud_report").alias("had_prior_fraud_report"))
        .agg(*(F.sum(F.col("side.weight") * F.col(m)).alias(m) for m in measures))
        .select(
            "had_prior_fraud_report",
            F.col("n_txn").alias("transactions"),
            F.col("n_fraud").alias("fraud_count"),
            pct("n_fraud", "n_flagged").alias("fraud_rate_pct"),
        )
    )


def report_lift(bank: Bank, dedupe: bool = False) -> DataFrame:
    """Rate with minus rate without a prior report; null when one of the groups is missing."""
    return lift_of(prior_report(bank, dedupe))


def lift_of(prior: DataFrame) -> DataFrame:
    rate, mark = F.col("fraud_rate_pct"), F.col("had_prior_fraud_report")
    sides = prior.agg(
        F.max(F.when(mark, rate)).alias("rate_with"),
        F.max(F.when(~mark, rate)).alias("rate_without"),
    )
    lift = F.col("rate_with") - F.col("rate_without")
    return sides.select(
        "rate_with",
        "rate_without",
        lift.alias("lift"),
        F.when(lift > 0, PREDICTOR).when(lift <= 0, NO_LINK).alias("verdict"),
    )


def is_default():
    return F.col("STATUS").isin(*DEFAULT_STATUSES)


def network_rate(bank: Bank) -> DataFrame:
    """Default rate per loan type over the whole bank."""
    return (
        present(bank["loan"], "LOAN_TYPE")
        .groupBy("LOAN_TYPE")
        .agg(ratio(F.count_if(is_default()), F.count(F.lit(1))).alias("network_default_rate"))
    )


def loans_with_network_rate(bank: Bank, as_of: Day = None) -> DataFrame:
    """Every loan with the default rate of its type: one of a few types, each of them hot.

    Nothing runs until the result is used. The rates are one row per type, so adaptive execution
    broadcasts them once it has measured their size.
    """
    return derived.loan_full(bank, as_of).join(network_rate(bank), "LOAN_TYPE", "left")


def branch_excess_raw(bank: Bank) -> DataFrame:
    """Actual against mix-expected default rate per named branch, with the unrounded excess.

    Loans are added up per branch and type first; only these sums meet the network rates.
    """
    cells = (
        present(bank["loan"], "BRANCH_ID")
        .groupBy("BRANCH_ID", "LOAN_TYPE")
        .agg(
            F.count("LOAN_ID").alias("loans"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(is_default()).alias("defaults"),
        )
    )
    return excess_of(cells, network_rate(bank), bank["branches"])


def excess_of(cells: DataFrame, rates: DataFrame, branches: DataFrame) -> DataFrame:
    """The same from loans, rows and defaults per branch and type, and the rate of each type."""
    rated = cells.join(rates, "LOAN_TYPE", "left")
    rate = F.col("network_default_rate")
    rated_rows = F.when(rate.isNotNull(), F.col("n_rows"))
    actual = ratio(F.sum("defaults"), F.sum("n_rows"))
    expected = ratio(F.sum(rate * F.col("n_rows")), F.sum(rated_rows))
    per_branch = rated.groupBy("BRANCH_ID").agg(
        F.sum("loans").alias("loans"),
        actual.alias("actual_default_rate"),
        expected.alias("expected_default_rate"),
    )
    named = per_branch.join(branches.select("BRANCH_ID", "BRANCH_NAME"), "BRANCH_ID")
    excess = F.col("actual_default_rate") - F.col("expected_default_rate")
    return named.withColumns(
        {
            "excess_default_rate": excess,
            "excess_default_pct": round_even(excess * 100),
            "actual_default_pct": round_even(F.col("actual_default_rate") * 100),
            "expected_default_pct": round_even(F.col("expected_default_rate") * 100),
        }
    )


BRANCH_COLUMNS = (
    "BRANCH_ID",
    "BRANCH_NAME",
    "loans",
    "actual_default_pct",
    "expected_default_pct",
    "excess_default_pct",
)


def branch_excess(bank: Bank) -> DataFrame:
    ranked = order_desc(branch_excess_raw(bank), "excess_default_pct", "BRANCH_ID")
    return ranked.select(*BRANCH_COLUMNS)


def positive_excess(bank: Bank) -> DataFrame:
    """Branches above expectation."""
    return branch_excess_raw(bank).filter("excess_default_rate > 0").select(*BRANCH_COLUMNS)


def largest_excess(bank: Bank, n: int = 15) -> DataFrame:
    """The ``n`` branches furthest from expectation, from best to worst."""
    raw = branch_excess_raw(bank)
    picked = top_by_size(
        raw, "excess_default_pct", n, F.col("excess_default_rate"), "BRANCH_ID"
    )
    return picked.select(*BRANCH_COLUMNS)


def escalated_tickets(bank: Bank, settled: Sequence[str] = SETTLED_TICKET_STATUSES) -> DataFrame:
    """Tickets not settled; the comparison is case-sensitive and an unknown status is open."""
    return bank["support_ticket"].filter(not_in("STATUS", settled))


def accounts_marked(bank: Bank, settled: Sequence[str] = SETTLED_TICKET_STATUSES) -> DataFrame:
    """Accounts of known customers with the mark ``had_escalated_ticket``.

    The mark is found per customer, one row each, and then given to the accounts, of which one
    customer may have very many.
    """
    marked = mark_exists(
        bank["customers"].select("CUSTOMER_ID"),
        "CUSTOMER_ID",
        escalated_tickets(bank, settled),
        "had_escalated_ticket",
    )
    return salted_lookup(
        bank["accounts"], marked, "CUSTOMER_ID", ["had_escalated_ticket"], "inner"
    )


def escalation_counts(bank: Bank, settled: Sequence[str] = SETTLED_TICKET_STATUSES) -> DataFrame:
    """Accounts per status and mark. Accounts are counted per customer before the joins."""
    per_customer = (
        present(bank["accounts"], "CUSTOMER_ID", "STATUS")
        .groupBy("CUSTOMER_ID", "STATUS")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return escalation_of(per_customer, bank["customers"], escalated_tickets(bank, settled))


def escalation_of(
    per_customer: DataFrame, customers: DataFrame, escalated: DataFrame
) -> DataFrame:
    """The same from accounts per customer and status, and tickets that are escalated."""
    known = per_customer.join(customers.select("CUSTOMER_ID"), "CUSTOMER_ID", "left_semi")
    marked = mark_exists(known, "CUSTOMER_ID", escalated, "had_escalated_ticket")
    return marked.groupBy("STATUS", "had_escalated_ticket").agg(F.sum("n").alias("n"))


MARK_VALUES, MARK_NAMES = (False, True), ("not_escalated_pct", "escalated_pct")


def escalation_crosstab(bank: Bank, by: str = "row") -> DataFrame:
    """Account status against escalation in percent of the row or of the column."""
    return escalation_shares(escalation_counts(bank), by)


def escalation_shares(counts: DataFrame, by: str = "row") -> DataFrame:
    return crosstab.crosstab_matrix(
        counts, "STATUS", "had_escalated_ticket", MARK_VALUES, MARK_NAMES, by
    ).orderBy("STATUS")


def escalation_risk(bank: Bank, risky: Sequence[str] = RISK_STATUSES) -> DataFrame:
    """Share of dormant and closed accounts among escalated customers and among the others."""
    return risk_of(escalation_counts(bank), risky)


def risk_of(counts: DataFrame, risky: Sequence[str] = RISK_STATUSES) -> DataFrame:
    n, mark = F.col("n"), F.col("had_escalated_ticket")
    risk = normalized("STATUS").isin(*risky)
    sides = counts.agg(
        ratio(F.sum(F.when(mark & risk, n).otherwise(0)), F.sum(F.when(mark, n))).alias("_with"),
        ratio(F.sum(F.when(~mark & risk, n).otherwise(0)), F.sum(F.when(~mark, n))).alias(
            "_without"
        ),
    )
    with_pct, without_pct = F.col("_with") * 100, F.col("_without") * 100
    return sides.select(
        with_pct.alias("escalated_risk_pct"),
        without_pct.alias("other_risk_pct"),
        F.when(with_pct > without_pct, LINKED)
        .when(with_pct <= without_pct, NO_LINK)
        .alias("verdict"),
    )


def util_fraud(bank: Bank) -> DataFrame:
    """Share of cards with fraud per utilisation band."""
    return (
        present(derived.card_util(bank), "util_band")
        .groupBy("util_band")
        .agg(mean_pct("fraud_on_card").alias("fraud_rate_pct"))
        .orderBy(UTILIZATION.position("util_band"))
    )


def riskiest_util_band(bank: Bank) -> DataFrame:
    return leading_key(util_fraud(bank), "util_band", "fraud_rate_pct")


def age_status_counts(bank: Bank, as_of: Day = None) -> DataFrame:
    aged = derived.accounts_aged(bank, as_of)
    return crosstab.crosstab_counts(aged, "account_age_band", "STATUS")


def age_status_crosstab(bank: Bank, as_of: Day = None) -> DataFrame:
    """Status mix per account age band in percent of the band."""
    names = [f"{s.lower()}_pct" for s in ACCOUNT_STATUSES]
    counts = age_status_counts(bank, as_of)
    return crosstab.crosstab_matrix(
        counts, "account_age_band", "STATUS", ACCOUNT_STATUSES, names
    ).orderBy(ACCOUNT_AGE.position("account_age_band"))


def leading_status_per_age(bank: Bank, as_of: Day = None) -> DataFrame:
    """The most common status in every age band, with its share."""
    return leading_status(age_status_counts(bank, as_of))


def leading_status(counts: DataFrame) -> DataFrame:
    shares = crosstab.crosstab_pct(counts, "account_age_band", "STATUS")
    return leading_per_group(shares, "account_age_band", "STATUS", "pct").select(
        "account_age_band", "STATUS", "pct"
    )
