"""Analyses on hand-made banks, with the expected rows written by hand."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import derived, descriptive, diagnostic, insights
from ledgerlens.plans.cells import Cells
from tests.conftest import day, rows

AS_OF = day("2002-01-01")


def txn(i, card, when=None, fraud=0, amount="10.00", category="Fuel"):
    return {
        "CARD_TXN_ID": i, "CARD_ID": card, "MERCHANT_CATEGORY": category,
        "AMOUNT": Decimal(amount), "TXN_DATE": day(when) if when else None, "IS_FRAUD": fraud,
    }


def card(i, customer, kind="Gold", limit="100.00"):
    return {
        "CARD_ID": i, "CUSTOMER_ID": customer, "CARD_TYPE": kind,
        "CREDIT_LIMIT": Decimal(limit) if limit else None,
    }


def report(i, customer, when, issue="Fraud Report", status="open"):
    return {
        "TICKET_ID": i, "CUSTOMER_ID": customer, "ISSUE_TYPE": issue, "STATUS": status,
        "DATE_OPENED": day(when) if when else None,
    }


def account(i, customer, status="Active", kind="Savings", balance="1.00", opened="2000-01-01"):
    return {
        "ACCOUNT_ID": i, "CUSTOMER_ID": customer, "ACCOUNT_TYPE": kind, "STATUS": status,
        "BALANCE": Decimal(balance) if balance else None, "OPEN_DATE": day(opened),
    }


def loan(i, customer=1, status="Active", kind="Home", branch=1, start="2000-01-01"):
    return {
        "LOAN_ID": i, "CUSTOMER_ID": customer, "BRANCH_ID": branch, "LOAN_TYPE": kind,
        "LOAN_AMOUNT": Decimal(100), "INTEREST_RATE": Decimal(7), "STATUS": status,
        "START_DATE": day(start) if start else None,
    }


def customer(i, income=1000.0, score=650):
    return {"CUSTOMER_ID": i, "ANNUAL_INCOME": income, "CREDIT_SCORE": score}


def test_groups_without_a_key_vanish(make_bank):
    bank = make_bank(
        accounts=[account(1, 1), account(2, 1, status=None), account(3, 1, kind=None)],
        cards=[card(1, 1)],
        card_transaction=[txn(1, 1, fraud=1), txn(2, 99)],
    )
    assert rows(descriptive.account_mix(bank), "ACCOUNT_TYPE", "STATUS", "accounts") == [
        ("Savings", "Active", 1)
    ]
    # The transaction of an unknown card has no card type.
    assert rows(descriptive.fraud_by_card_type(bank)) == [("Gold", 1, 1, 100.0)]


def test_sum_of_nothing_is_zero_and_mean_is_null(make_bank):
    bank = make_bank(accounts=[account(1, 1, balance=None)])
    assert rows(descriptive.account_mix(bank)) == [("Savings", "Active", 1, 0.0, None)]


def test_missing_transaction_date(make_bank):
    bank = make_bank(cards=[card(1, 1)], card_transaction=[txn(1, 1), txn(2, 1, "2001-05-06")])
    months = rows(descriptive.fraud_by_month(bank), "txn_month", "total_txn")
    assert months == [("2001-05", 1), ("NaT", 1)]
    ages = rows(derived.card_txn(bank, AS_OF), "CARD_TXN_ID", "days_since_txn")
    assert ages == [(1, None), (2, 240)]


def test_reports_are_not_deduplicated_unless_asked(make_bank):
    bank = make_bank(
        cards=[card(1, 1), card(2, 2)],
        support_ticket=[
            report(1, 1, "2001-01-05"),
            report(2, 1, "2001-01-10"),
            report(3, 1, "2001-02-01"),
            report(4, 1, None),
            report(5, 1, "2000-01-01", issue="KYC"),
        ],
        card_transaction=[
            txn(1, 1, "2001-01-10", fraud=1),
            txn(2, 1, "2001-01-01"),
            txn(3, 2, "2001-01-10"),
            txn(4, 1, None, fraud=1),
        ],
    )
    # Transaction 1 follows two of four reports, one of them on the same day.
    assert rows(diagnostic.prior_report(bank)) == [
        (False, 11, 6, 54.55),
        (True, 2, 2, 100.0),
    ]
    assert rows(diagnostic.prior_report(bank, dedupe=True)) == [
        (False, 3, 1, 33.33),
        (True, 1, 1, 100.0),
    ]
    marked = rows(diagnostic.txn_after_report(bank), "CARD_TXN_ID", "had_prior_fraud_report")
    assert marked == [(1, True), (2, False), (3, False), (4, False)]
    lift = diagnostic.report_lift(bank).first()
    assert (lift.rate_with, lift.rate_without, lift.verdict) == (100.0, 54.55, "strong predictor")


def test_lift_needs_both_groups(make_bank):
    bank = make_bank(cards=[card(1, 1)], card_transaction=[txn(1, 1, "2001-01-01")])
    assert rows(diagnostic.report_lift(bank)) == [(None, 0.0, None, None)]


def test_transactions_carry_their_report_counts(make_bank):
    bank = make_bank(
        cards=[card(1, 1)],
        support_ticket=[report(1, 1, "2001-01-05"), report(2, 1, "2001-03-05")],
        card_transaction=[txn(1, 1, "2001-02-01"), txn(2, 1, None), txn(3, 9, "2001-02-01")],
    )
    got = rows(
        diagnostic.txn_reports(bank),
        "CARD_TXN_ID", "n_reports", "n_prior_reports", "had_prior_fraud_report",
    )
    assert got == [(1, 2, 1, True), (2, 2, 0, False), (3, 0, 0, False)]


def test_escalation_is_case_sensitive_and_unknown_is_open(make_bank):
    tickets = [
        report(1, 1, "2001-01-01", status="closed"),
        report(2, 2, "2001-01-01", status="Closed"),
        report(3, 3, "2001-01-01", status=None),
        report(4, 3, "2001-01-01", status="open"),
        report(5, None, "2001-01-01", status="open"),
    ]
    bank = make_bank(
        customers=[customer(i) for i in (1, 2, 3)],
        accounts=[account(i, i) for i in (1, 2, 3, 4)],
        support_ticket=tickets,
    )
    got = rows(diagnostic.accounts_marked(bank), "ACCOUNT_ID", "had_escalated_ticket")
    # Account 4 belongs to no customer.
    assert got == [(1, False), (2, True), (3, True)]
    also = rows(
        diagnostic.accounts_marked(bank, settled=("closed", "Closed")),
        "ACCOUNT_ID", "had_escalated_ticket",
    )
    assert also == [(1, False), (2, False), (3, True)]


def test_escalation_tables(make_bank):
    bank = make_bank(
        customers=[customer(1), customer(2)],
        accounts=[
            account(1, 1, "Active"), account(2, 1, "Dormant"), account(3, 1, "Dormant "),
            account(4, 2, "Active"), account(5, 2, "Closed"), account(6, 2, None),
        ],
        support_ticket=[report(1, 1, "2001-01-01")],
    )
    assert rows(diagnostic.escalation_crosstab(bank)) == [
        ("Active", 50.0, 50.0), ("Closed", 100.0, 0.0), ("Dormant ", 0.0, 100.0),
        ("Dormant", 0.0, 100.0),
    ]
    assert rows(diagnostic.escalation_crosstab(bank, by="column")) == [
        ("Active", 50.0, 33.33), ("Closed", 50.0, 0.0), ("Dormant ", 0.0, 33.33),
        ("Dormant", 0.0, 33.33),
    ]
    risk = diagnostic.escalation_risk(bank).first()
    assert round(risk.escalated_risk_pct, 6) == round(200 / 3, 6)
    assert (risk.other_risk_pct, risk.verdict) == (50.0, "linked")


def test_utilization_ignores_cards_without_a_limit(make_bank):
    bank = make_bank(
        cards=[card(1, 1), card(2, 1, limit="0.00"), card(3, 1, limit=None), card(4, 1)],
        card_transaction=[txn(1, 1, amount="50.00", fraud=1), txn(2, 2, amount="5.00")],
    )
    assert rows(derived.card_util(bank), "CARD_ID", "utilization_pct", "util_band", "fraud_on_card") == [
        (1, 50.0, "25-50%", 1), (2, None, None, 0), (3, None, None, 0), (4, 0.0, None, 0),
    ]
    assert rows(descriptive.util_by_card_type(bank)) == [("Gold", 25.0)]
    assert rows(diagnostic.util_fraud(bank)) == [("25-50%", 100.0)]


def test_loans_without_payments_are_never_late(make_bank):
    payments = [
        {"PAYMENT_ID": i, "LOAN_ID": 1, "LATE_PAYMENT_FLAG": flag} for i, flag in ((1, 0), (2, 1))
    ]
    bank = make_bank(loan=[loan(1), loan(2, status=None), loan(3, status="Written Off", start=None)],
                     loan_payment=payments)
    assert rows(
        derived.loan_full(bank, AS_OF), "LOAN_ID", "ever_late", "is_default", "tenure_band"
    ) == [(1, 1, 0, "2-5y"), (2, 0, 0, "2-5y"), (3, 0, 1, None)]
    assert rows(descriptive.default_by_tenure(bank, AS_OF)) == [("2-5y", 2, 0.0, 50.0)]


def test_branch_excess_against_the_loan_mix(make_bank):
    # Home: 1 of 2 defaults, Auto: 1 of 4. Branch 3 has no name.
    bank = make_bank(
        branches=[{"BRANCH_ID": 1, "BRANCH_NAME": "North"}, {"BRANCH_ID": 2, "BRANCH_NAME": "South"}],
        loan=[
            loan(1, kind="Home", branch=1, status="Defaulted"), loan(2, kind="Home", branch=2),
            loan(3, kind="Auto", branch=1), loan(4, kind="Auto", branch=2),
            loan(5, kind="Auto", branch=2, status="Written Off"), loan(6, kind="Auto", branch=3),
        ],
    )
    assert rows(diagnostic.branch_excess(bank)) == [
        (1, "North", 2, 50.0, 37.5, 12.5), (2, "South", 3, 33.33, 33.33, 0.0),
    ]
    assert rows(diagnostic.positive_excess(bank), "BRANCH_NAME") == [("North",)]
    assert [r.BRANCH_NAME for r in diagnostic.largest_excess(bank, 2).collect()] == [
        "South", "North",
    ]


def test_category_gap_uses_all_transactions(make_bank):
    bank = make_bank(
        card_transaction=[
            txn(1, 1, fraud=1, category="Fuel"), txn(2, 1, category="Fuel"),
            txn(3, 1, category="Food"), txn(4, 1, category=None),
        ]
    )
    expected = [("Food", 1, 0, 0.0, -25.0), ("Fuel", 2, 1, 50.0, 25.0)]
    assert rows(diagnostic.category_disproportion(bank)) == expected
    assert rows(diagnostic.category_minus_baseline(bank)) == expected


def test_leading_status_per_age_band(make_bank):
    bank = make_bank(
        accounts=[
            account(1, 1, "Closed", opened="2001-06-01"), account(2, 1, opened="2001-06-01"),
            account(3, 1, "Dormant", opened="1999-01-01"), account(4, 1, "Frozen", opened="1980-01-01"),
        ]
    )
    assert rows(diagnostic.leading_status_per_age(bank, AS_OF)) == [
        ("0-1yr", "Active", 50.0), ("2yr+", "Dormant", 100.0),
    ]
    assert rows(diagnostic.age_status_crosstab(bank, AS_OF)) == [
        ("0-1yr", 50.0, 0.0, 50.0, 0.0), ("2yr+", 0.0, 100.0, 0.0, 0.0),
    ]


def test_resolution_days_floor_the_clock(make_bank, spark):
    bank = make_bank()
    tickets = spark.createDataFrame(
        [(1, dt.datetime(2001, 1, 1, 23), dt.datetime(2001, 1, 2, 1)),
         (2, dt.datetime(2001, 1, 2), dt.datetime(2001, 1, 1, 23))],
        "TICKET_ID int, DATE_OPENED timestamp_ntz, DATE_RESOLVED timestamp_ntz",
    )
    bank._open["support_ticket"] = tickets
    assert rows(derived.tickets(bank), "TICKET_ID", "resolution_days") == [(1, 0), (2, -1)]


def test_credit_bands_of_loans(make_bank):
    bank = make_bank(
        customers=[customer(1, score=600), customer(2, score=601), customer(3, score=0)],
        loan=[loan(1, 1, "Defaulted"), loan(2, 2), loan(3, 3), loan(4, 9)],
    )
    assert rows(diagnostic.credit_band_risk(bank, AS_OF)) == [
        ("600-700", 1, 0.0, 0.0), ("<600", 1, 100.0, 0.0),
    ]


def test_build_derived_is_lazy_and_complete(make_bank):
    tables = derived.build_derived(make_bank(), AS_OF)
    assert set(tables) == {
        "card_txn", "loan_full", "customers", "customers_with_balance", "card_util",
        "transaction_list", "support_ticket", "accounts", "branches",
    }
    assert tables["card_util"].count() == 0


def test_insights_name_the_leaders(spark, sf_dir):
    from ledgerlens import testbed

    bank = testbed.bank_on(spark, sf_dir)
    facts = {r.analysis: r for r in insights.facts(bank, testbed.AS_OF).collect()}
    sentences = {r.analysis: r.sentence for r in insights.sentences(bank, testbed.AS_OF).collect()}
    assert set(facts) == set(sentences)
    leader = descriptive.fraud_by_category(bank).orderBy(
        F.desc("fraud_rate_pct"), "MERCHANT_CATEGORY"
    ).first()
    assert facts["fraud_by_category"].key == leader.MERCHANT_CATEGORY
    assert leader.MERCHANT_CATEGORY in sentences["fraud_by_category"]
    assert f"{leader.fraud_rate_pct:.2f}%" in sentences["fraud_by_category"]


@pytest.fixture
def quick_plans(spark):
    """Many plans over a few rows: one partition and no compiled code."""
    settings = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_cells_give_the_facts_of_the_full_analyses(quick_plans, make_bank):
    """Null keys, null measures and values outside the declared domains, against the base tables."""
    day = dt.date(2001, 5, 1)
    keys = [1, 2, 3, None]
    bank = make_bank(
        customers=[
            {"CUSTOMER_ID": i, "ANNUAL_INCOME": 100.0 * i, "CREDIT_SCORE": 550 + 60 * i} for i in (1, 2, 3, 4)
        ],
        cards=[
            {"CARD_ID": i, "CUSTOMER_ID": keys[i % 4], "CARD_TYPE": ["Gold", None, "Debit"][i % 3],
             "CREDIT_LIMIT": Decimal(100 * (i % 3))} for i in range(8)
        ],
        card_transaction=[
            {"CARD_TXN_ID": i, "CARD_ID": [i % 9, None][i % 11 == 0], "AMOUNT": [Decimal(i), None][i % 5 == 0],
             "MERCHANT_CATEGORY": ["Fuel", "Travel", None][i % 3], "IS_FRAUD": [1, 0, 0, None][i % 4],
             "TXN_DATE": [day + dt.timedelta(i % 6), None][i % 13 == 0]} for i in range(90)
        ],
        loan=[
            {"LOAN_ID": i, "CUSTOMER_ID": keys[i % 4], "BRANCH_ID": [7, 8, None][i % 3],
             "LOAN_TYPE": ["Home", "Auto", None][i % 4 % 3], "LOAN_AMOUNT": Decimal(i), "START_DATE": day,
             "INTEREST_RATE": [Decimal("5.25"), None][i % 5 == 0],
             "STATUS": ["Active", "Defaulted", None][i % 7 % 3]} for i in range(40)
        ],
        loan_payment=[
            {"PAYMENT_ID": i, "LOAN_ID": i % 20, "LATE_PAYMENT_FLAG": [0, 1, None][i % 3]} for i in range(50)
        ],
        branches=[{"BRANCH_ID": b, "BRANCH_NAME": f"b{b}"} for b in (7, 8)],
        accounts=[
            {"ACCOUNT_ID": i, "CUSTOMER_ID": [*keys, 9][i % 5], "ACCOUNT_TYPE": ["NRI", "Salary", None][i % 3],
             "STATUS": ["Active", "Dormant", "Frozen", None][i % 4], "BALANCE": [Decimal(i), None][i % 6 == 0],
             "OPEN_DATE": day - dt.timedelta(100 * i)} for i in range(40)
        ],
        support_ticket=[
            {"TICKET_ID": i, "CUSTOMER_ID": keys[i % 4], "ISSUE_TYPE": ["Fraud Report", "KYC", None][i % 3],
             "STATUS": ["open", "closed", None][i % 5 % 3], "DATE_OPENED": [day + dt.timedelta(i % 6), None][i % 7 == 0],
             "DATE_RESOLVED": day + dt.timedelta(9)} for i in range(30)
        ],
    )
    cells = Cells(bank, day)
    today = dt.date(2002, 1, 1)
    cells.as_of = today

    def same(found, wanted, *names):
        assert rows(found.select(*names)) == rows(wanted.select(*names))

    same(cells.account_mix(), descriptive.account_mix(bank), "ACCOUNT_TYPE", "STATUS", "accounts", "total_balance")
    same(cells.loan_types(), descriptive.loan_mix(bank), "LOAN_TYPE", "total_disbursed", "avg_interest_rate")
    same(cells.loan_types(), descriptive.default_by_loan_type(bank, today), "LOAN_TYPE", "default_rate_pct", "late_rate_pct")
    same(cells.categories(), descriptive.fraud_by_category(bank), "MERCHANT_CATEGORY", "fraud_rate_pct")
    same(cells.categories(), descriptive.spend_vs_fraud(bank), "MERCHANT_CATEGORY", "total_spend")
    same(
        cells.card_types().filter("total_txn is not null"), descriptive.fraud_by_card_type(bank),
        "CARD_TYPE", "fraud_rate_pct",
    )
    same(cells.card_types(), descriptive.util_by_card_type(bank), "CARD_TYPE", "utilization_pct")
    same(cells.util_bands(), diagnostic.util_fraud(bank), "util_band", "fraud_rate_pct")
    same(cells.issues(), descriptive.ticket_summary(bank), "ISSUE_TYPE", "tickets", "avg_resolution_days")
    same(cells.segments(), descriptive.segmentation(bank), "income_band", "credit_band", "avg_balance")
    same(
        cells.credit_bands(), diagnostic.credit_band_risk(bank, today),
        "credit_band", "loans", "defaults_rate_pct", "late_rate_pct",
    )
    same(cells.positive_excess(), diagnostic.positive_excess(bank), *diagnostic.BRANCH_COLUMNS)
    same(cells.report_lift(), diagnostic.report_lift(bank), "rate_with", "rate_without", "verdict")
    same(cells.escalation, diagnostic.escalation_counts(bank), "STATUS", "had_escalated_ticket", "n")
    same(cells.age_leaders(), diagnostic.leading_status_per_age(bank, today), "account_age_band", "STATUS", "pct")


def test_insights_do_not_scan_event_tables_again(spark, sf_dir):
    from ledgerlens import testbed

    plan = insights.facts(testbed.bank_on(spark, sf_dir), testbed.AS_OF)._jdf.queryExecution().optimizedPlan()
    scans = [str(leaf.toString()) for leaf in (plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size()))]
    assert scans and not any("l_orderkey" in s or "event_id" in s for s in scans)


def test_model_sentences(spark):
    best = spark.createDataFrame([("fraud", "forest", 0.9123)], "task string, best_model string, roc_auc double")
    weights = spark.createDataFrame(
        [("fraud", "b", 0.4), ("fraud", "a", 0.4), ("fraud", "c", 0.2)], "task string, feature string, importance double"
    )
    assert rows(insights.model_sentences(best, weights)) == [(
        "model_fraud",
        "forest performs best on the fraud task (ROC-AUC 0.912); a is the strongest driver,"
        " with 40.0% of the forest's decision weight.",
    )]
