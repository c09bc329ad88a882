"""The shared aggregates of a bank: each event table is read once, all facts roll up from here.

An event table is grouped by several sets of keys in one scan (``GROUPING SETS``), and what comes
out, one row per cell, is written to the shared folder. Every insight then reads these small
tables. Sums, counts and extremes are kept, so rates and means of any coarser grouping are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.bank import Bank
from ledgerlens.functions.scalars import not_in, pct, ratio, round_even, sum_or_zero
from ledgerlens.operators.joins import lookup
from ledgerlens.plans import derived, descriptive, diagnostic
from ledgerlens.plans.derived import Day, present
from ledgerlens.schema import FRAUD_REPORT_ISSUE, SETTLED_TICKET_STATUSES
from ledgerlens.sources.scratch import written


def grouped(df: DataFrame, sets: dict[str, Sequence[str]], **measures: Column) -> DataFrame:
    """Cells of all ``sets`` of keys from one scan of ``df``; ``cell`` names the set of a row.

    A null key of a set is told from a key that is not part of it by the grouping bits.
    """
    keys = list(dict.fromkeys(k for columns in sets.values() for k in columns))
    bits = {name: sum(1 << i for i, k in enumerate(reversed(keys)) if k not in columns)
            for name, columns in sets.items()}
    cell = F.lit(None).cast("string")
    for name, bit in bits.items():
        cell = F.when(F.col("_bits") == bit, name).otherwise(cell)
    found = df.groupingSets([[F.col(k) for k in c] for c in sets.values()], *keys).agg(
        F.grouping_id().alias("_bits"), *(m.alias(name) for name, m in measures.items())
    )
    return found.withColumn("cell", cell).drop("_bits")


class Cells:
    """Cell tables of one bank and the analyses that roll up from them."""

    def __init__(self, bank: Bank, as_of: Day = None):
        self.bank, self.as_of = bank, as_of

    def build(self) -> Cells:
        """Write all cell tables now, those that do not need each other at the same time."""
        names = ("cards", "loans", "accounts", "tickets")
        with ThreadPoolExecutor(len(names)) as pool:
            tasks = [inheritable_thread_target(lambda n=n: getattr(self, n)) for n in names]
            for job in [pool.submit(task) for task in tasks]:
                job.result()
        return self

    # ---- cell tables, written on first use ----------------------------------------------------

    @cached_property
    def spending(self) -> DataFrame:
        """Card transactions per card and day, and per merchant category."""
        cells = grouped(
            self.bank["card_transaction"],
            {"card_day": ["CARD_ID", "TXN_DATE"], "category": ["MERCHANT_CATEGORY"]},
            n_txn=F.count("CARD_TXN_ID"),
            n_fraud=sum_or_zero("IS_FRAUD"),
            n_flagged=F.count("IS_FRAUD"),
            spend=F.sum("AMOUNT"),
            any_fraud=F.max((F.col("IS_FRAUD") == 1).cast("int")),
        )
        return written(cells, "cells-spending")

    @cached_property
    def cards(self) -> DataFrame:
        """Cards per type and per utilisation band, with what their transactions add up to."""
        per_card = present(self._of(self.spending, "card_day"), "CARD_ID").groupBy("CARD_ID").agg(
            F.sum("n_txn").alias("total_txn"),
            F.sum("n_fraud").alias("fraud_txn"),
            F.coalesce(F.sum("spend"), F.lit(0)).alias("total_spend"),
            F.max("any_fraud").alias("any_fraud"),
        )
        used = derived.cards_used(self.bank["cards"], per_card)
        exact = F.col("utilization_pct").cast("decimal(28,2)")
        cells = grouped(
            used.withColumn("_exact", exact),
            {"type": ["CARD_TYPE"], "band": ["util_band"]},
            total_txn=F.sum("total_txn"),
            fraud_txn=F.sum("fraud_txn"),
            used=F.sum("_exact"),
            n_used=F.count("_exact"),
            n_fraud_cards=F.sum("fraud_on_card"),
            n_cards=F.count("fraud_on_card"),
        )
        return written(cells, "cells-cards")

    @cached_property
    def loans(self) -> DataFrame:
        """Loans with their late marks per customer, and per branch and type."""
        cells = grouped(
            derived.loan_full(self.bank, self.as_of),
            {"customer": ["CUSTOMER_ID"], "branch_type": ["BRANCH_ID", "LOAN_TYPE"]},
            loans=F.count("LOAN_ID"),
            n_rows=F.count(F.lit(1)),
            defaults=F.sum("is_default"),
            late=F.sum("ever_late"),
            amount=F.sum("LOAN_AMOUNT"),
            interest=F.sum("INTEREST_RATE"),
            n_interest=F.count("INTEREST_RATE"),
        )
        return written(cells, "cells-loans")

    @cached_property
    def accounts(self) -> DataFrame:
        """Accounts by status per customer, per type and per age band."""
        cells = grouped(
            derived.accounts_aged(self.bank, self.as_of),
            {
                "customer": ["CUSTOMER_ID", "STATUS"],
                "type": ["ACCOUNT_TYPE", "STATUS"],
                "age": ["account_age_band", "STATUS"],
            },
            accounts=F.count("ACCOUNT_ID"),
            n=F.count(F.lit(1)),
            balance=F.sum("BALANCE"),
            n_balance=F.count("BALANCE"),
        )
        return written(cells, "cells-accounts")

    @cached_property
    def tickets(self) -> DataFrame:
        """Tickets per issue, and per customer by escalation and day of a fraud report."""
        report = F.col("ISSUE_TYPE").eqNullSafe(FRAUD_REPORT_ISSUE)
        marked = derived.tickets(self.bank).withColumns(
            {
                "escalated": not_in("STATUS", SETTLED_TICKET_STATUSES),
                "is_report": report,
                "fraud_report_date": F.when(report, F.col("DATE_OPENED")),
            }
        )
        cells = grouped(
            marked,
            {
                "issue": ["ISSUE_TYPE"],
                "customer": ["CUSTOMER_ID", "escalated", "is_report", "fraud_report_date"],
            },
            tickets=F.count("TICKET_ID"),
            n=F.count(F.lit(1)),
            days=F.sum("resolution_days"),
            n_days=F.count("resolution_days"),
        )
        return written(cells, "cells-tickets")

    @staticmethod
    def _of(cells: DataFrame, name: str) -> DataFrame:
        return cells.filter(F.col("cell") == name)

    # ---- roll-ups: the same columns as the analyses over the base tables ----------------------

    def account_mix(self) -> DataFrame:
        return present(self._of(self.accounts, "type"), "ACCOUNT_TYPE", "STATUS").select(
            "ACCOUNT_TYPE",
            "STATUS",
            "accounts",
            F.coalesce("balance", F.lit(0)).cast("double").alias("total_balance"),
        )

    def loan_types(self) -> DataFrame:
        """Mix and rates per loan type."""
        types = present(self._of(self.loans, "branch_type"), "LOAN_TYPE").groupBy("LOAN_TYPE")
        return types.agg(
            sum_or_zero("amount").cast("double").alias("total_disbursed"),
            ratio(F.sum("interest"), F.sum("n_interest")).alias("avg_interest_rate"),
            pct(F.sum("defaults"), F.sum("n_rows")).alias("default_rate_pct"),
            pct(F.sum("late"), F.sum("n_rows")).alias("late_rate_pct"),
        )

    def categories(self) -> DataFrame:
        """Fraud rate and spend per merchant category."""
        found = present(self._of(self.spending, "category"), "MERCHANT_CATEGORY")
        return found.select(
            "MERCHANT_CATEGORY",
            pct("n_fraud", "n_txn").alias("fraud_rate_pct"),
            F.coalesce("spend", F.lit(0)).cast("double").alias("total_spend"),
        )

    def card_types(self) -> DataFrame:
        """Fraud rate (of types with transactions) and utilisation per card type."""
        return present(self._of(self.cards, "type"), "CARD_TYPE").select(
            "CARD_TYPE",
            "total_txn",
            pct("fraud_txn", "total_txn").alias("fraud_rate_pct"),
            round_even(ratio("used", "n_used")).alias("utilization_pct"),
        )

    def util_bands(self) -> DataFrame:
        found = present(self._of(self.cards, "band"), "util_band")
        return found.select("util_band", pct("n_fraud_cards", "n_cards").alias("fraud_rate_pct"))

    def issues(self) -> DataFrame:
        return present(self._of(self.tickets, "issue"), "ISSUE_TYPE").select(
            "ISSUE_TYPE", "tickets", ratio("days", "n_days").alias("avg_resolution_days")
        )

    def segments(self, approx: bool = False) -> DataFrame:
        per_customer = present(self._of(self.accounts, "customer"), "CUSTOMER_ID")
        balances = per_customer.groupBy("CUSTOMER_ID").agg(
            ratio(F.sum("balance"), F.sum("n_balance")).alias("BALANCE")
        )
        return descriptive.segments(derived.customers_banded(self.bank, approx), balances)

    def credit_bands(self) -> DataFrame:
        per_customer = present(self._of(self.loans, "customer"), "CUSTOMER_ID")
        return diagnostic.credit_band_rates(per_customer, self.bank["customers"])

    def positive_excess(self) -> DataFrame:
        cells = self._of(self.loans, "branch_type")
        rates = present(cells, "LOAN_TYPE").groupBy("LOAN_TYPE").agg(
            ratio(F.sum("defaults"), F.sum("n_rows")).alias("network_default_rate")
        )
        branches = present(cells, "BRANCH_ID").select("BRANCH_ID", "LOAN_TYPE", "loans", "n_rows", "defaults")
        raw = diagnostic.excess_of(branches, rates, self.bank["branches"])
        return raw.filter("excess_default_rate > 0").select(*diagnostic.BRANCH_COLUMNS)

    def report_lift(self) -> DataFrame:
        days = self._of(self.spending, "card_day")
        owned = lookup(days, self.bank["cards"], "CARD_ID", ["CUSTOMER_ID"])
        owned = owned.groupBy("CUSTOMER_ID", "TXN_DATE").agg(
            *(F.sum(c).alias(c) for c in ("n_txn", "n_fraud", "n_flagged"))
        )
        reports = self._of(self.tickets, "customer").filter("is_report")
        return diagnostic.lift_of(diagnostic.prior_rates(owned, reports, count="n"))

    @cached_property
    def escalation(self) -> DataFrame:
        """Accounts per status and escalation mark."""
        per_customer = present(self._of(self.accounts, "customer"), "CUSTOMER_ID", "STATUS")
        escalated = self._of(self.tickets, "customer").filter("escalated")
        counts = diagnostic.escalation_of(
            per_customer.select("CUSTOMER_ID", "STATUS", "n"), self.bank["customers"], escalated
        )
        return written(counts, "cells-escalation")

    def age_leaders(self) -> DataFrame:
        """The most common status of every account age band."""
        counts = present(self._of(self.accounts, "age"), "account_age_band", "STATUS")
        return diagnostic.leading_status(counts)

