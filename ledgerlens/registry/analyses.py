"""Queries on the named analyses, rankings and insights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.bands import CREDIT
from ledgerlens.functions.scalars import round_even
from ledgerlens.operators import profiling, ranking
from ledgerlens.plans import derived, descriptive, diagnostic, insights
from ledgerlens.registry.core import Context, query
from ledgerlens.schema import KEYS, TABLES, measure_columns, struct_for
from ledgerlens.testbed import AS_OF


def _fraud_sql(view: str, key: str) -> str:
    return f"""select {key}, count(CARD_TXN_ID) as total_txn,
      cast(sum(IS_FRAUD) as bigint) as fraud_txn,
      round_even(cast(sum(IS_FRAUD) as double) / count(CARD_TXN_ID) * 100, 2) as fraud_rate_pct
    from {view} where {key} is not null group by {key}"""


def _default_sql(key: str) -> str:
    return f"""select {key}, count(LOAN_ID) as loans,
      round_even(cast(sum(is_default) as double) / count(*) * 100, 2) as default_rate_pct,
      round_even(cast(sum(ever_late) as double) / count(*) * 100, 2) as late_rate_pct
    from loan_full where {key} is not null group by {key}"""


@query(
    "desc_account_mix",
    """select ACCOUNT_TYPE, STATUS, count(ACCOUNT_ID) as accounts,
      cast(sum(BALANCE) as double) as total_balance,
      cast(sum(BALANCE) as double) / count(BALANCE) as avg_balance
    from accounts group by ACCOUNT_TYPE, STATUS""",
)
def desc_account_mix(context: Context) -> DataFrame:
    return descriptive.account_mix(context.bank)


@query(
    "desc_account_share",
    """select ACCOUNT_TYPE, count(ACCOUNT_ID) as accounts,
      round_even(cast(count(ACCOUNT_ID) as double) / (select count(*) from accounts) * 100, 2)
        as share_pct
    from accounts group by ACCOUNT_TYPE""",
)
def desc_account_share(context: Context) -> DataFrame:
    return descriptive.account_share(context.bank)


@query(
    "desc_card_mix",
    """select CARD_TYPE, count(CARD_ID) as cards,
      cast(sum(CREDIT_LIMIT) as double) as total_credit_balance,
      cast(sum(CREDIT_LIMIT) as double) / count(CREDIT_LIMIT) as avg_credit_balance
    from cards group by CARD_TYPE""",
)
def desc_card_mix(context: Context) -> DataFrame:
    return descriptive.card_mix(context.bank)


@query(
    "desc_loan_mix",
    """select LOAN_TYPE, count(LOAN_ID) as loans,
      cast(sum(LOAN_AMOUNT) as double) as total_disbursed,
      cast(sum(INTEREST_RATE) as double) / count(INTEREST_RATE) as avg_interest_rate
    from loan group by LOAN_TYPE""",
)
def desc_loan_mix(context: Context) -> DataFrame:
    return descriptive.loan_mix(context.bank)


@query("desc_fraud_by_category", _fraud_sql("card_transaction", "MERCHANT_CATEGORY"))
def desc_fraud_by_category(context: Context) -> DataFrame:
    return descriptive.fraud_by_category(context.bank)


@query("desc_fraud_by_card_type", _fraud_sql("card_txn", "CARD_TYPE"))
def desc_fraud_by_card_type(context: Context) -> DataFrame:
    return descriptive.fraud_by_card_type(context.bank)


@query("desc_fraud_by_month", _fraud_sql("card_txn", "txn_month"))
def desc_fraud_by_month(context: Context) -> DataFrame:
    return descriptive.fraud_by_month(context.bank)


@query("agg_ever_late", "select LOAN_ID, ever_late from payment_history")
def agg_ever_late(context: Context) -> DataFrame:
    return derived.ever_late(context.bank)


@query("desc_default_by_loan_type", _default_sql("LOAN_TYPE"))
def desc_default_by_loan_type(context: Context) -> DataFrame:
    return descriptive.default_by_loan_type(context.bank, AS_OF)


@query("desc_default_by_branch", _default_sql("BRANCH_ID"))
def desc_default_by_branch(context: Context) -> DataFrame:
    return descriptive.default_by_branch(context.bank, AS_OF)


@query("desc_default_by_tenure", _default_sql("tenure_band"))
def desc_default_by_tenure(context: Context) -> DataFrame:
    return descriptive.default_by_tenure(context.bank, AS_OF)


@query(
    "desc_ticket_summary",
    """select ISSUE_TYPE, count(TICKET_ID) as tickets,
      cast(sum(resolution_days) as double) / nullif(count(resolution_days), 0)
        as avg_resolution_days
    from tickets_timed where ISSUE_TYPE is not null group by ISSUE_TYPE""",
)
def desc_ticket_summary(context: Context) -> DataFrame:
    return descriptive.ticket_summary(context.bank)


@query(
    "desc_spend_vs_fraud",
    """select MERCHANT_CATEGORY, cast(sum(AMOUNT) as double) as total_spend,
      count(CARD_TXN_ID) as total_txn,
      round_even(cast(sum(IS_FRAUD) as double) / count(IS_FRAUD) * 100, 2) as fraud_rate_pct
    from card_transaction where MERCHANT_CATEGORY is not null group by MERCHANT_CATEGORY""",
)
def desc_spend_vs_fraud(context: Context) -> DataFrame:
    return descriptive.spend_vs_fraud(context.bank)


@query("agg_customer_balance", "select CUSTOMER_ID, BALANCE from customer_balance")
def agg_customer_balance(context: Context) -> DataFrame:
    return derived.customer_balance(context.bank)


SEGMENT_SQL = """
  select c.income_band, c.credit_band, count(c.CUSTOMER_ID) as customers,
    round_even(avg(b.BALANCE), 4) as avg_balance
  from customers_banded c left join customer_balance b on c.CUSTOMER_ID = b.CUSTOMER_ID
  where c.income_band is not null and c.credit_band is not null
  group by c.income_band, c.credit_band"""


@query("desc_segmentation", SEGMENT_SQL)
def desc_segmentation(context: Context) -> DataFrame:
    segments = descriptive.segmentation(context.bank)
    return segments.withColumn("avg_balance", round_even(F.col("avg_balance"), 4))


@query(
    "pivot_segmentation",
    "select income_band, "
    + ", ".join(
        f"max(case when credit_band = '{c}' then avg_balance end) as \"{c}\""
        for c in CREDIT.labels
    )
    + " from desc_segmentation group by income_band",
)
def pivot_segmentation(context: Context) -> DataFrame:
    matrix = descriptive.segmentation_matrix(context.bank)
    return matrix.withColumns({c: round_even(F.col(f"`{c}`"), 4) for c in CREDIT.labels})


@query(
    "agg_card_spend",
    """select CARD_ID, cast(sum(AMOUNT) as double) as total_spend
      from card_transaction group by CARD_ID""",
)
def agg_card_spend(context: Context) -> DataFrame:
    totals = derived.card_totals(context.bank)
    return totals.select("CARD_ID", totals["total_spend"].cast("double").alias("total_spend"))


@query(
    "desc_util_by_card_type",
    """select CARD_TYPE, round_even(
      cast(sum(cast(utilization_pct as decimal(28,2))) as double)
        / nullif(count(utilization_pct), 0), 2) as utilization_pct
    from card_util group by CARD_TYPE""",
)
def desc_util_by_card_type(context: Context) -> DataFrame:
    return descriptive.util_by_card_type(context.bank)


@query(
    "desc_monthly_trend",
    """select txn_month, count(TRANSACTION_ID) as txn_count,
      cast(sum(AMOUNT) as double) as total_amount
    from (select *, coalesce(strftime(TXN_DATE, '%Y-%m'), 'NaT') as txn_month
      from transaction_list) t group by txn_month""",
)
def desc_monthly_trend(context: Context) -> DataFrame:
    return descriptive.monthly_trend(context.bank)


@query(
    "diag_credit_band_risk",
    """select c.credit_band, count(l.LOAN_ID) as loans,
      round_even(cast(sum(l.is_default) as double) / count(*) * 100, 2) as defaults_rate_pct,
      round_even(cast(sum(l.ever_late) as double) / count(*) * 100, 2) as late_rate_pct
    from loan_full l left join customers_banded c on l.CUSTOMER_ID = c.CUSTOMER_ID
    where c.credit_band is not null group by c.credit_band""",
)
def diag_credit_band_risk(context: Context) -> DataFrame:
    return diagnostic.credit_band_risk(context.bank, AS_OF)


@query(
    "agg_overall_fraud_rate",
    """select cast(sum(IS_FRAUD) as double) / count(IS_FRAUD) * 100 as overall_fraud_rate
      from card_transaction""",
)
def agg_overall_fraud_rate(context: Context) -> DataFrame:
    return diagnostic.overall_fraud_rate(context.bank)


@query(
    "diag_category_disproportion",
    """select MERCHANT_CATEGORY, total_txn, fraud_txn, fraud_rate_pct,
      fraud_rate_pct - (select cast(sum(IS_FRAUD) as double) / count(IS_FRAUD) * 100
        from card_transaction) as disproportionate
    from desc_fraud_by_category""",
)
def diag_category_disproportion(context: Context) -> DataFrame:
    return diagnostic.category_disproportion(context.bank)


@query(
    "diag_prior_report",
    """select mark as had_prior_fraud_report, count(CARD_TXN_ID) as transactions,
      cast(sum(IS_FRAUD) as bigint) as fraud_count,
      round_even(cast(sum(IS_FRAUD) as double) / count(IS_FRAUD) * 100, 2) as fraud_rate_pct
    from txn_report_pairs group by mark""",
)
def diag_prior_report(context: Context) -> DataFrame:
    return diagnostic.prior_report(context.bank)


@query(
    "diag_report_lift",
    """select rate_with, rate_without, rate_with - rate_without as lift,
      case when rate_with - rate_without > 0 then 'strong predictor'
        when rate_with - rate_without <= 0 then 'no link' end as verdict
    from (select max(case when had_prior_fraud_report then fraud_rate_pct end) as rate_with,
        max(case when not had_prior_fraud_report then fraud_rate_pct end) as rate_without
      from diag_prior_report) p""",
)
def diag_report_lift(context: Context) -> DataFrame:
    return diagnostic.report_lift(context.bank)


@query("agg_network_rate", "select LOAN_TYPE, network_default_rate from network_rate")
def agg_network_rate(context: Context) -> DataFrame:
    return diagnostic.network_rate(context.bank)


BRANCH_SQL = """select BRANCH_ID, BRANCH_NAME, loans, actual_default_pct, expected_default_pct,
  excess_default_pct from branch_raw"""


@query("diag_branch_excess", BRANCH_SQL)
def diag_branch_excess(context: Context) -> DataFrame:
    return diagnostic.branch_excess(context.bank)


def _mark_sql(total: str) -> str:
    cells = ", ".join(
        f"round_even(cast(count(*) filter (where {test}) as double) / {total} * 100, 2) as {name}"
        for test, name, total in (
            ("not had_escalated_ticket", "not_escalated_pct", total.format(test="not m")),
            ("had_escalated_ticket", "escalated_pct", total.format(test="m")),
        )
    )
    return f"select STATUS, {cells} from accounts_marked where STATUS is not null group by STATUS"


@query("diag_escalation_crosstab", _mark_sql("count(*)"))
def diag_escalation_crosstab(context: Context) -> DataFrame:
    return diagnostic.escalation_crosstab(context.bank)


@query(
    "diag_escalation_crosstab_col",
    _mark_sql(
        "(select count(*) from (select had_escalated_ticket as m, STATUS as s"
        " from accounts_marked) k where s is not null and {test})"
    ),
)
def diag_escalation_crosstab_col(context: Context) -> DataFrame:
    return diagnostic.escalation_crosstab(context.bank, by="column")


@query(
    "diag_escalation_risk",
    """select 100 * w as escalated_risk_pct, 100 * o as other_risk_pct,
      case when w > o then 'linked' when w <= o then 'no link' end as verdict
    from (
      select cast(count(*) filter (where had_escalated_ticket and risky) as double)
          / nullif(count(*) filter (where had_escalated_ticket), 0) as w,
        cast(count(*) filter (where not had_escalated_ticket and risky) as double)
          / nullif(count(*) filter (where not had_escalated_ticket), 0) as o
      from (select *, lower(trim(STATUS)) in ('dormant', 'closed') as risky
        from accounts_marked where STATUS is not null) a) s""",
)
def diag_escalation_risk(context: Context) -> DataFrame:
    return diagnostic.escalation_risk(context.bank)


@query(
    "diag_util_fraud",
    """select util_band, round_even(cast(sum(fraud_on_card) as double) / count(*) * 100, 2)
      as fraud_rate_pct from card_util where util_band is not null group by util_band""",
)
def diag_util_fraud(context: Context) -> DataFrame:
    return diagnostic.util_fraud(context.bank)


@query(
    "diag_age_status_crosstab",
    "select account_age_band, "
    + ", ".join(
        f"round_even(cast(count(*) filter (where {test}) as double) / count(*) * 100, 2) as {name}"
        for test, name in (
            ("STATUS = 'Active'", "active_pct"),
            ("STATUS = 'Dormant'", "dormant_pct"),
            ("STATUS = 'Closed'", "closed_pct"),
            ("STATUS not in ('Active', 'Dormant', 'Closed')", "other_pct"),
        )
    )
    + " from accounts_aged where account_age_band is not null and STATUS is not null"
    " group by account_age_band",
)
def diag_age_status_crosstab(context: Context) -> DataFrame:
    return diagnostic.age_status_crosstab(context.bank, AS_OF)


@query(
    "agg_pay_stats",
    "select LOAN_ID, payments_made, late_payments, late_ratio from payment_history",
)
def agg_pay_stats(context: Context) -> DataFrame:
    return derived.pay_stats(context.bank)


@query("agg_distinct_values", "select distinct STATUS from support_ticket")
def agg_distinct_values(context: Context) -> DataFrame:
    return context["support_ticket"].select("STATUS").distinct()


# ---- profiles ---------------------------------------------------------------------------------


def _text_sql(table: str) -> str:
    parts = [
        f"cast(cast({f.name} as decimal(38,2)) as varchar)"
        if f.dataType.typeName() == "double"
        else f"cast({f.name} as varchar)"
        for f in struct_for(table)
    ]
    order = ", ".join([KEYS[table], *(f.name for f in struct_for(table) if f.name != KEYS[table])])
    return f"""(select '{table}' as table_name, {KEYS[table]} as row_key,
      concat_ws('|', {', '.join(parts)}) as row_text from {table} order by {order} limit 5)"""


@query("prof_head", " union all ".join(f"select * from {_text_sql(t)} h" for t in TABLES))
def prof_head(context: Context) -> DataFrame:
    return profiling.head_all(context.bank, KEYS)


@query(
    "prof_shape",
    " union all ".join(
        f"select '{t}' as table_name, count(*) as n_rows, "
        f"cast({len(struct_for(t).names)} as int) as n_columns from {t}"
        for t in TABLES
    ),
)
def prof_shape(context: Context) -> DataFrame:
    return profiling.shape(context.bank)


@query(
    "prof_info",
    " union all ".join(
        f"select '{t}' as table_name, '{f.name}' as column_name, "
        f"'{f.dataType.simpleString()}' as data_type, count({f.name}) as non_null from {t}"
        for t in TABLES
        for f in struct_for(t)
    ),
)
def prof_info(context: Context) -> DataFrame:
    return profiling.info(context.bank)


def _describe_sql(table: str, column: str) -> str:
    value = f"cast({column} as double)"
    quartiles = ", ".join(
        f"round_even(quantile_cont({value}, {q}), 4) as {n}"
        for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))
    )
    return f"""select '{table}' as table_name, '{column}' as column_name, count({column}) as n,
      round_even(cast(sum({column}) as double) / count({column}), 4) as mean,
      round_even(stddev_samp({value}), 4) as std, min({value}) as min, {quartiles},
      max({value}) as max from {table}"""


MEASURES = {t: measure_columns(t) for t in TABLES if measure_columns(t)}


@query(
    "prof_describe", " union all ".join(_describe_sql(t, c) for t in MEASURES for c in MEASURES[t])
)
def prof_describe(context: Context) -> DataFrame:
    rounded = ("mean", "std", "p25", "p50", "p75")
    described = profiling.describe(context.bank, MEASURES)
    return described.withColumns({c: round_even(F.col(c), 4) for c in rounded})


# ---- orderings --------------------------------------------------------------------------------


@query("sort_desc", "select * from desc_spend_vs_fraud order by total_spend desc")
def sort_desc(context: Context) -> DataFrame:
    spend = descriptive.spend_vs_fraud(context.bank)
    return ranking.order_desc(spend, "total_spend", "MERCHANT_CATEGORY")


@query("sort_multi", "select * from desc_segmentation order by income_band, credit_band")
def sort_multi(context: Context) -> DataFrame:
    segments = desc_segmentation(context)
    return segments.orderBy(
        descriptive.INCOME.position("income_band"), CREDIT.position("credit_band")
    )


@query(
    "topk_worst_branches",
    """select * from desc_default_by_branch
      order by default_rate_pct desc, BRANCH_ID limit 10""",
)
def topk_worst_branches(context: Context) -> DataFrame:
    return descriptive.worst_branches(context.bank, AS_OF)


@query(
    "topk_abs_excess",
    f"""select * from ({BRANCH_SQL} order by abs(excess_default_pct) desc, BRANCH_ID limit 15) b
      order by excess_default_pct, BRANCH_ID""",
)
def topk_abs_excess(context: Context) -> DataFrame:
    return diagnostic.largest_excess(context.bank)


@query(
    "top1_row",
    """select * from desc_account_mix order by accounts desc, ACCOUNT_TYPE, STATUS limit 1""",
)
def top1_row(context: Context) -> DataFrame:
    mix = descriptive.account_mix(context.bank)
    return ranking.top(mix, "accounts", 1, "ACCOUNT_TYPE", "STATUS")


@query(
    "idxmax_band",
    "select * from diag_util_fraud order by fraud_rate_pct desc, util_band limit 1",
)
def idxmax_band(context: Context) -> DataFrame:
    return diagnostic.riskiest_util_band(context.bank)


@query(
    "idxmax_per_row",
    """select account_age_band, STATUS, pct from (
      select *, row_number() over (partition by account_age_band order by pct desc, STATUS) as rn
      from (
        select account_age_band, STATUS, round_even(cast(count(*) as double)
          / sum(count(*)) over (partition by account_age_band) * 100, 2) as pct
        from accounts_aged where account_age_band is not null and STATUS is not null
        group by account_age_band, STATUS) c) r
    where rn = 1""",
)
def idxmax_per_row(context: Context) -> DataFrame:
    return diagnostic.leading_status_per_age(context.bank, AS_OF)


# ---- insights ---------------------------------------------------------------------------------


def _money(column: str) -> str:
    return f"format('{{:,}}', cast(round_even({column}, 0) as bigint))"


# (analysis, source, key, value, order, rows, sentence): the naive form, over the full analyses.
INSIGHTS = [
    ("account_mix", "desc_account_mix", "ACCOUNT_TYPE || '/' || STATUS", "total_balance",
     "accounts desc, ACCOUNT_TYPE, STATUS", 1,
     "'Most accounts are ' || ACCOUNT_TYPE || '/' || STATUS || ', with a balance of '"
     f" || {_money('total_balance')} || ' in all.'"),
    ("loan_mix", "desc_loan_mix", "LOAN_TYPE", "total_disbursed",
     "total_disbursed desc, LOAN_TYPE", 1,
     f"printf('The largest loan book is %s: %s paid out at %.2f%% on average.', LOAN_TYPE,"
     f" {_money('total_disbursed')}, avg_interest_rate)"),
    ("fraud_by_category", "desc_fraud_by_category", "MERCHANT_CATEGORY", "fraud_rate_pct",
     "fraud_rate_pct desc, MERCHANT_CATEGORY", 1,
     "printf('Fraud is most frequent in %s (%.2f%% of transactions).', MERCHANT_CATEGORY,"
     " fraud_rate_pct)"),
    ("fraud_by_card_type", "desc_fraud_by_card_type", "CARD_TYPE", "fraud_rate_pct",
     "fraud_rate_pct desc, CARD_TYPE", 1,
     "printf('Among card types, %s has the highest fraud rate (%.2f%%).', CARD_TYPE,"
     " fraud_rate_pct)"),
    ("default_by_loan_type", "desc_default_by_loan_type", "LOAN_TYPE", "default_rate_pct",
     "default_rate_pct desc, LOAN_TYPE", 1,
     "printf('%s loans default most often (%.2f%%); %.2f%% of them were ever paid late.',"
     " LOAN_TYPE, default_rate_pct, late_rate_pct)"),
    ("most_tickets", "desc_ticket_summary", "ISSUE_TYPE", "tickets",
     "tickets desc, ISSUE_TYPE", 1,
     "printf('%s causes the most tickets (%d).', ISSUE_TYPE, tickets)"),
    ("slowest_tickets", "desc_ticket_summary", "ISSUE_TYPE", "avg_resolution_days",
     "avg_resolution_days desc, ISSUE_TYPE", 1,
     "printf('%s takes longest to resolve (%.1f days).', ISSUE_TYPE, avg_resolution_days)"),
    ("top_spend", "desc_spend_vs_fraud", "MERCHANT_CATEGORY", "total_spend",
     "total_spend desc, MERCHANT_CATEGORY", 1,
     f"printf('Most is spent on %s (%s).', MERCHANT_CATEGORY, {_money('total_spend')})"),
    ("segmentation", "desc_segmentation", "income_band || '/' || credit_band", "avg_balance",
     "avg_balance desc, income_band, credit_band", 1,
     "printf('The best balance (%s) is held in income band %s, credit band %s.',"
     f" {_money('avg_balance')}, income_band, credit_band)"),
    ("utilization", "desc_util_by_card_type", "CARD_TYPE", "utilization_pct",
     "utilization_pct desc nulls last, CARD_TYPE", 1,
     "printf('%s cards use most of their limit (%.2f%%): review limits or offers.', CARD_TYPE,"
     " utilization_pct)"),
    ("credit_band_default", "diag_credit_band_risk", "credit_band", "defaults_rate_pct",
     "defaults_rate_pct desc, credit_band", 1,
     "printf('Credit band %s defaults most often (%.2f%%).', credit_band, defaults_rate_pct)"),
    ("credit_band_late", "diag_credit_band_risk", "credit_band", "late_rate_pct",
     "late_rate_pct desc, credit_band", 1,
     "printf('Credit band %s pays late most often (%.2f%%).', credit_band, late_rate_pct)"),
    ("report_lift", "diag_report_lift", "verdict", "round_even(lift, 2)", "1", 1,
     "printf('Fraud rate %.2f%% after a report of the customer, %.2f%% otherwise (%+.2f points):"
     " %s.', rate_with, rate_without, lift, verdict)"),
    ("branches_above_expected", "filt_positive_excess", "BRANCH_NAME", "count(*) over ()",
     "excess_default_pct desc, BRANCH_ID", 1,
     "printf('%d branches default more than their loan mix explains; %s most (%+.2f points).',"
     " count(*) over (), BRANCH_NAME, excess_default_pct)"),
    ("escalation_risk", "diag_escalation_risk", "verdict", "round_even(escalated_risk_pct, 4)",
     "1", 1,
     "printf('%.1f%% of accounts of customers with escalated tickets are dormant or closed,"
     " %.1f%% of the others: %s.', escalated_risk_pct, other_risk_pct, verdict)"),
    ("util_band_fraud", "diag_util_fraud", "util_band", "fraud_rate_pct",
     "fraud_rate_pct desc, util_band", 1,
     "printf('Cards in utilisation band %s see fraud most often (%.2f%%).', util_band,"
     " fraud_rate_pct)"),
    ("escalated_share", "diag_escalation_crosstab_col", "STATUS", "escalated_pct", "STATUS", 100,
     "printf('%.1f%% of accounts of customers with escalated tickets are %s, %.1f%% of the"
     " others.', escalated_pct, STATUS, not_escalated_pct)"),
    ("age_status", "idxmax_per_row", "account_age_band || '/' || STATUS", "pct",
     "account_age_band", 100,
     "printf('Accounts aged %s are mostly %s (%.2f%%).', account_age_band, STATUS, pct)"),
]
FACTS_SQL = " union all ".join(
    f"""select * from (select '{name}' as analysis, {key} as "key",
      cast({value} as double) as value from {source} order by {order} limit {rows}) f"""
    for name, source, key, value, order, rows, _ in INSIGHTS
).replace("cast(avg_balance as double)", "round_even(avg_balance, 4)")
SENTENCES_SQL = " union all ".join(
    f"""select * from (select '{name}' as analysis, {sentence} as sentence
      from {source} order by {order} limit {rows}) f"""
    for name, source, _, _, order, rows, sentence in INSIGHTS
)


@query("insight_table_facts", FACTS_SQL)
def insight_table_facts(context: Context) -> DataFrame:
    return insights.facts(context.bank, AS_OF)


@query("insight_table", SENTENCES_SQL)
def insight_table(context: Context) -> DataFrame:
    return insights.sentences(context.bank, AS_OF)
