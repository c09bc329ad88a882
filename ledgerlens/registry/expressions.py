"""Queries on cleaning, projection, filters, scalar expressions and bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import bands, scalars
from ledgerlens.models import features, scoring
from ledgerlens.operators import cleaning
from ledgerlens.plans import derived, diagnostic
from ledgerlens.registry.core import Context, query
from ledgerlens.registry.sources import plain
from ledgerlens.registry.views import AS_OF_SQL
from ledgerlens.schema import (
    DEFAULT_STATUSES,
    SETTLED_TICKET_STATUSES,
    TABLES,
    integer_columns,
    text_columns,
)
from ledgerlens.testbed import AS_OF


@query(
    "clean_headers",
    """select CUSTOMER_ID, CUSTOMER_NAME, ANNUAL_INCOME, CREDIT_SCORE, JOIN_DATE, DATE_OF_BIRTH
      from customers""",
)
def clean_headers(context: Context) -> DataFrame:
    customers = context["customers"]
    messy = customers.toDF(*(f" {c.title()}  " for c in customers.columns))
    return cleaning.clean_headers(messy)


@query(
    "clean_dates",
    """select LOAN_ID, case when LOAN_ID % 7 not in (0, 1) then cast(START_DATE as varchar)
      || case when LOAN_ID % 7 = 2 then ' 23:00:00' else ' 00:00:00' end end as START_DATE
    from loan""",
)
def clean_dates(context: Context) -> DataFrame:
    """Dates stored as text in several forms, some of them unreadable or missing."""
    key, day = F.col("LOAN_ID") % 7, F.col("START_DATE")
    text = F.when(key == 0, "garbage").when(key == 1, F.lit(None))
    text = text.when(key == 2, F.concat(day.cast("string"), F.lit(" 23:00")))
    for i, form in enumerate(cleaning.DATE_FORMATS, 3):
        text = text.when(key == i, F.date_format(day, form))
    stored = context["loan"].select("LOAN_ID", text.alias("START_DATE"))
    read = cleaning.parse_dates(stored, "loan")
    return read.withColumn("START_DATE", F.date_format("START_DATE", "yyyy-MM-dd HH:mm:ss"))


def _narrow_sql(table: str, column: str) -> str:
    wide = "int" if column in ("CREDIT_SCORE", "LATE_PAYMENT_FLAG", "IS_FRAUD") else "bigint"
    return f"""select '{table}' as table_name, '{column}' as column_name,
      case when min({column}) is null then '{wide}'
        when min({column}) >= -128 and max({column}) <= 127 then 'tinyint'
        when min({column}) >= -32768 and max({column}) <= 32767 then 'smallint'
        when min({column}) >= -2147483648 and max({column}) <= 2147483647 then 'int'
        else 'bigint' end as narrow_type from {table}"""


@query(
    "clean_narrow_ints",
    " union all ".join(_narrow_sql(t, c) for t in TABLES for c in integer_columns(t)),
)
def clean_narrow_ints(context: Context) -> DataFrame:
    """The type every integer column is narrowed to, one aggregation per table."""
    reports = [
        cleaning.narrow_int_types(context[t], integer_columns(t))
        .unpivot([], integer_columns(t), "column_name", "narrow_type")
        .select(F.lit(t).alias("table_name"), "column_name", "narrow_type")
        for t in TABLES
    ]
    return reduce(DataFrame.unionByName, reports)


@query(
    "clean_float32",
    "select CUSTOMER_ID, cast(ANNUAL_INCOME as float) as ANNUAL_INCOME from customers",
)
def clean_float32(context: Context) -> DataFrame:
    incomes = context["customers"].select("CUSTOMER_ID", "ANNUAL_INCOME")
    return cleaning.narrow_floats(incomes)


@query(
    "profile_cardinality",
    "select table_name, column_name, n_rows, n_distinct,"
    " n_distinct < greatest(1000.0, n_rows * 0.3) as low_cardinality from ("
    + " union all ".join(
        f"select '{t}' as table_name, '{c}' as column_name, count(*) as n_rows, "
        f"count(distinct {c}) as n_distinct from {t}"
        for t in TABLES
        for c in text_columns(t)
    )
    + ") p",
)
def profile_cardinality(context: Context) -> DataFrame:
    return cleaning.text_cardinality(context.bank)


@query("proj_select", "select CARD_ID, CARD_TYPE from cards")
def proj_select(context: Context) -> DataFrame:
    return context["cards"].select("CARD_ID", "CARD_TYPE")


@query(
    "proj_rename",
    "select TICKET_ID, CUSTOMER_ID, DATE_OPENED as fraud_report_date from support_ticket",
)
def proj_rename(context: Context) -> DataFrame:
    tickets = context["support_ticket"].select("TICKET_ID", "CUSTOMER_ID", "DATE_OPENED")
    return tickets.withColumnRenamed("DATE_OPENED", "fraud_report_date")


@query(
    "proj_drop",
    """select LOAN_ID, CREDIT_SCORE, cast(LOAN_AMOUNT as double) as LOAN_AMOUNT,
      cast(INTEREST_RATE as double) as INTEREST_RATE, payments_made, late_ratio from late_frame""",
)
def proj_drop(context: Context) -> DataFrame:
    """Features without the label."""
    return features.late_features(context.bank, AS_OF).drop(features.LATE.label)


@query("filt_eq", "select CUSTOMER_ID, fraud_report_date from fraud_reports")
def filt_eq(context: Context) -> DataFrame:
    return diagnostic.fraud_reports(context.bank)


@query("filt_active_loans", "select LOAN_ID, CUSTOMER_ID, STATUS from loan where STATUS = 'Active'")
def filt_active_loans(context: Context) -> DataFrame:
    return scoring.active_loans(context["loan"]).select("LOAN_ID", "CUSTOMER_ID", "STATUS")


@query(
    "filt_positive_excess",
    """select BRANCH_ID, BRANCH_NAME, loans, actual_default_pct, expected_default_pct,
      excess_default_pct from branch_raw where excess_default_rate > 0""",
)
def filt_positive_excess(context: Context) -> DataFrame:
    return diagnostic.positive_excess(context.bank)


@query(
    "pred_in_list",
    """select LOAN_ID, case when STATUS in ('Defaulted', 'Written Off') then 1 else 0 end
      as is_default from loan""",
)
def pred_in_list(context: Context) -> DataFrame:
    flag = scalars.is_in("STATUS", DEFAULT_STATUSES)
    return context["loan"].select("LOAN_ID", flag.alias("is_default"))


@query(
    "pred_not_in_list",
    """select distinct STATUS from support_ticket
      where STATUS is null or STATUS not in ('closed', 'resolved')""",
)
def pred_not_in_list(context: Context) -> DataFrame:
    tickets = context["support_ticket"].select("STATUS")
    return tickets.filter(scalars.not_in("STATUS", SETTLED_TICKET_STATUSES)).distinct()


@query(
    "pred_prior_event",
    """select o.CARD_TXN_ID, (r.first_report is not null and o.TXN_DATE >= r.first_report)
      as had_prior_fraud_report
    from txn_owner o left join (
      select CUSTOMER_ID, min(fraud_report_date) as first_report
      from fraud_reports group by CUSTOMER_ID) r on o.CUSTOMER_ID = r.CUSTOMER_ID""",
)
def pred_prior_event(context: Context) -> DataFrame:
    """Was there a report at or before the transaction? The first one decides, one per customer."""
    marked = diagnostic.txn_after_report(context.bank)
    return marked.select("CARD_TXN_ID", "had_prior_fraud_report")


@query("fill_zero", "select CARD_ID, cast(total_spend as double) as total_spend from card_util")
def fill_zero(context: Context) -> DataFrame:
    """Spend per card, 0 for cards that were never used."""
    spend = derived.card_totals(context.bank).select("CARD_ID", "total_spend")
    joined = context["cards"].select("CARD_ID").join(spend, "CARD_ID", "left")
    return plain(joined.na.fill(0, ["total_spend"]))


@query(
    "feat_dropna",
    """select CARD_ID, utilization_pct, util_band from card_util
      where utilization_pct is not null and util_band is not null""",
)
def feat_dropna(context: Context) -> DataFrame:
    used = derived.card_util(context.bank).select("CARD_ID", "utilization_pct", "util_band")
    return used.na.drop(subset=["utilization_pct", "util_band"])


@query("expr_utilization", "select CARD_ID, utilization_pct from card_util")
def expr_utilization(context: Context) -> DataFrame:
    return derived.card_util(context.bank).select("CARD_ID", "utilization_pct")


@query("expr_month", "select CARD_TXN_ID, txn_month from card_txn")
def expr_month(context: Context) -> DataFrame:
    month = scalars.month_of("TXN_DATE")
    return context["card_transaction"].select("CARD_TXN_ID", month.alias("txn_month"))


@query(
    "expr_as_of",
    f"""select LOAN_ID, {AS_OF_SQL} as as_of, START_DATE <= {AS_OF_SQL} as started from loan""",
)
def expr_as_of(context: Context) -> DataFrame:
    day = scalars.as_of_date(AS_OF)
    return context["loan"].select(
        "LOAN_ID", day.alias("as_of"), (F.col("START_DATE") <= day).alias("started")
    )


@query("expr_days_since", "select CARD_TXN_ID, days_since_txn from card_txn")
def expr_days_since(context: Context) -> DataFrame:
    txns = context["card_transaction"]
    days = scalars.days_between(scalars.as_of_date(AS_OF), "TXN_DATE")
    return txns.select("CARD_TXN_ID", days.alias("days_since_txn"))


@query("expr_tenure_days", "select LOAN_ID, tenure_days from loan_full")
def expr_tenure_days(context: Context) -> DataFrame:
    days = scalars.elapsed_days(context["loan"], scalars.as_of_date(AS_OF), "START_DATE")
    return context["loan"].select("LOAN_ID", days.alias("tenure_days"))


@query("expr_resolution_days", "select TICKET_ID, resolution_days from tickets_timed")
def expr_resolution_days(context: Context) -> DataFrame:
    return derived.tickets(context.bank).select("TICKET_ID", "resolution_days")


@query("expr_account_age", "select ACCOUNT_ID, account_age_days from accounts_aged")
def expr_account_age(context: Context) -> DataFrame:
    return derived.accounts_aged(context.bank, AS_OF).select("ACCOUNT_ID", "account_age_days")


@query("band_tenure", "select LOAN_ID, tenure_band from loan_full")
def band_tenure(context: Context) -> DataFrame:
    days = scalars.elapsed_days(context["loan"], scalars.as_of_date(AS_OF), "START_DATE")
    return context["loan"].select("LOAN_ID", bands.TENURE.label(days).alias("tenure_band"))


@query("band_credit", "select CUSTOMER_ID, credit_band from customers_banded")
def band_credit(context: Context) -> DataFrame:
    label = bands.CREDIT.label("CREDIT_SCORE")
    return context["customers"].select("CUSTOMER_ID", label.alias("credit_band"))


@query("band_utilization", "select CARD_ID, util_band from card_util")
def band_utilization(context: Context) -> DataFrame:
    return derived.card_util(context.bank).select("CARD_ID", "util_band")


@query("band_account_age", "select ACCOUNT_ID, account_age_band from accounts_aged")
def band_account_age(context: Context) -> DataFrame:
    return derived.accounts_aged(context.bank, AS_OF).select("ACCOUNT_ID", "account_age_band")


@query("band_income_quartile", "select CUSTOMER_ID, income_band from customers_banded")
def band_income_quartile(context: Context) -> DataFrame:
    banded = bands.with_quartile_band(context["customers"], "ANNUAL_INCOME", "income_band")
    return banded.select("CUSTOMER_ID", "income_band")


@query(
    "expr_ratio_pct",
    """select CARD_ID, round_even(cast(sum(IS_FRAUD) as double) / count(CARD_TXN_ID) * 100, 2)
      as fraud_rate_pct from card_transaction group by CARD_ID""",
)
def expr_ratio_pct(context: Context) -> DataFrame:
    rate = scalars.pct("fraud_txn", "total_txn")
    return derived.card_totals(context.bank).select("CARD_ID", rate.alias("fraud_rate_pct"))


@query("expr_late_ratio", "select LOAN_ID, late_ratio from payment_history")
def expr_late_ratio(context: Context) -> DataFrame:
    return derived.pay_stats(context.bank).select("LOAN_ID", "late_ratio")


@query("expr_abs", "select BRANCH_ID, abs(excess_default_pct) as abs_excess_pct from branch_raw")
def expr_abs(context: Context) -> DataFrame:
    excess = diagnostic.branch_excess_raw(context.bank)
    return excess.select("BRANCH_ID", F.abs("excess_default_pct").alias("abs_excess_pct"))


@query("expr_normalize_text", "select ACCOUNT_ID, lower(trim(STATUS)) as status_key from accounts")
def expr_normalize_text(context: Context) -> DataFrame:
    key = scalars.normalized("STATUS")
    return context["accounts"].select("ACCOUNT_ID", key.alias("status_key"))


@query(
    "expr_bool_to_int",
    "select ACCOUNT_ID, cast(had_escalated_ticket as int) as had_escalated from accounts_marked",
)
def expr_bool_to_int(context: Context) -> DataFrame:
    marked = diagnostic.accounts_marked(context.bank)
    return marked.select(
        "ACCOUNT_ID", F.col("had_escalated_ticket").cast("int").alias("had_escalated")
    )
