"""Views the SQL checks share: the bank tables and the derived tables, in ANSI SQL."""

from __future__ import annotations

from ledgerlens.testbed import ANSI_HEX, SCORE_SQL, SOURCE_DDL, TABLE_SQL

AS_OF_SQL = "date '2002-01-01'"

VIEWS: dict[str, str] = {
    table: sql.format(**{s: s for s in SOURCE_DDL}) for table, sql in TABLE_SQL.items()
}

VIEWS["card_txn"] = f"""
  select t.*, c.CARD_TYPE, coalesce(strftime(t.TXN_DATE, '%Y-%m'), 'NaT') as txn_month,
    cast(datediff('day', t.TXN_DATE, {AS_OF_SQL}) as int) as days_since_txn
  from card_transaction t left join cards c on t.CARD_ID = c.CARD_ID"""

VIEWS["payment_history"] = """
  select LOAN_ID, max(LATE_PAYMENT_FLAG) as ever_late, count(PAYMENT_ID) as payments_made,
    cast(sum(LATE_PAYMENT_FLAG) as bigint) as late_payments,
    cast(sum(LATE_PAYMENT_FLAG) as double) / nullif(count(PAYMENT_ID), 0) as late_ratio
  from loan_payment group by LOAN_ID"""

VIEWS["loan_full"] = f"""
  select *, case when tenure_days > -1 and tenure_days <= 180 then '<6m'
      when tenure_days > 180 and tenure_days <= 365 then '6-12m'
      when tenure_days > 365 and tenure_days <= 730 then '1-2y'
      when tenure_days > 730 and tenure_days <= 1825 then '2-5y'
      when tenure_days > 1825 and tenure_days <= 10000 then '5y+' end as tenure_band
  from (
    select l.*, coalesce(h.ever_late, 0) as ever_late,
      case when l.STATUS in ('Defaulted', 'Written Off') then 1 else 0 end as is_default,
      cast(datediff('day', l.START_DATE, {AS_OF_SQL}) as int) as tenure_days
    from loan l left join payment_history h on l.LOAN_ID = h.LOAN_ID) x"""

VIEWS["customers_banded"] = """
  select c.*, case when ANNUAL_INCOME <= q25 then 'Q1' when ANNUAL_INCOME <= q50 then 'Q2'
      when ANNUAL_INCOME <= q75 then 'Q3' else 'Q4' end as income_band,
    case when CREDIT_SCORE > 0 and CREDIT_SCORE <= 600 then '<600'
      when CREDIT_SCORE > 600 and CREDIT_SCORE <= 700 then '600-700'
      when CREDIT_SCORE > 700 and CREDIT_SCORE <= 800 then '700-800'
      when CREDIT_SCORE > 800 and CREDIT_SCORE <= 900 then '800+' end as credit_band
  from customers c, (
    select quantile_cont(ANNUAL_INCOME, 0.25) as q25, quantile_cont(ANNUAL_INCOME, 0.5) as q50,
      quantile_cont(ANNUAL_INCOME, 0.75) as q75 from customers) e"""

VIEWS["customer_balance"] = """
  select CUSTOMER_ID, cast(sum(BALANCE) as double) / count(BALANCE) as BALANCE
  from accounts group by CUSTOMER_ID"""

VIEWS["card_util"] = """
  select *, case when utilization_pct > 0 and utilization_pct <= 25 then '0-25%'
      when utilization_pct > 25 and utilization_pct <= 50 then '25-50%'
      when utilization_pct > 50 and utilization_pct <= 75 then '50-75%'
      when utilization_pct > 75 and utilization_pct <= 300 then '75%+' end as util_band
  from (
    select c.*, coalesce(s.total_spend, 0) as total_spend,
      case when CREDIT_LIMIT > 0 then round_even(
        cast(coalesce(s.total_spend, 0) as double) / cast(CREDIT_LIMIT as double) * 100, 2)
        end as utilization_pct,
      case when c.CARD_ID in (select CARD_ID from card_transaction where IS_FRAUD = 1)
        then 1 else 0 end as fraud_on_card
    from cards c left join (
      select CARD_ID, sum(AMOUNT) as total_spend from card_transaction group by CARD_ID) s
    on c.CARD_ID = s.CARD_ID) x"""

VIEWS["tickets_timed"] = """
  select *, cast(datediff('day', DATE_OPENED, DATE_RESOLVED) as int) as resolution_days
  from support_ticket"""

VIEWS["accounts_aged"] = f"""
  select *, case when account_age_days > 0 and account_age_days <= 365 then '0-1yr'
      when account_age_days > 365 and account_age_days <= 730 then '1-2yr'
      when account_age_days > 730 and account_age_days <= 3650 then '2yr+' end
    as account_age_band
  from (
    select *, cast(datediff('day', OPEN_DATE, {AS_OF_SQL}) as int) as account_age_days
    from accounts) x"""

VIEWS["fraud_reports"] = """
  select CUSTOMER_ID, DATE_OPENED as fraud_report_date
  from support_ticket where ISSUE_TYPE = 'Fraud Report'"""

VIEWS["txn_owner"] = """
  select t.CARD_TXN_ID, t.CARD_ID, c.CUSTOMER_ID, t.TXN_DATE, t.IS_FRAUD
  from card_transaction t left join cards c on t.CARD_ID = c.CARD_ID"""

# One row per transaction and report: the fan-out that the Spark plan only counts.
VIEWS["txn_report_pairs"] = """
  select o.*, r.fraud_report_date,
    (r.fraud_report_date is not null and o.TXN_DATE >= r.fraud_report_date) as mark
  from txn_owner o left join fraud_reports r on o.CUSTOMER_ID = r.CUSTOMER_ID"""

VIEWS["network_rate"] = """
  select LOAN_TYPE, cast(sum(is_default) as double) / count(*) as network_default_rate
  from loan_full group by LOAN_TYPE"""

VIEWS["branch_raw"] = """
  select b.BRANCH_ID, n.BRANCH_NAME, loans, excess as excess_default_rate,
    round_even(actual * 100, 2) as actual_default_pct,
    round_even(expected * 100, 2) as expected_default_pct,
    round_even(excess * 100, 2) as excess_default_pct
  from (
    select BRANCH_ID, count(LOAN_ID) as loans,
      cast(sum(is_default) as double) / count(*) as actual,
      avg(network_default_rate) as expected,
      cast(sum(is_default) as double) / count(*) - avg(network_default_rate) as excess
    from loan_full l left join network_rate r on l.LOAN_TYPE = r.LOAN_TYPE
    group by BRANCH_ID) b
  join branches n on b.BRANCH_ID = n.BRANCH_ID"""

VIEWS["accounts_marked"] = """
  select a.*, (a.CUSTOMER_ID in (
      select CUSTOMER_ID from support_ticket
      where CUSTOMER_ID is not null and (STATUS is null or STATUS not in ('closed', 'resolved'))))
    as had_escalated_ticket
  from accounts a join customers c on a.CUSTOMER_ID = c.CUSTOMER_ID"""

VIEWS["default_frame"] = """
  select l.*, c.CREDIT_SCORE, c.ANNUAL_INCOME
  from loan_full l join customers c on l.CUSTOMER_ID = c.CUSTOMER_ID"""

VIEWS["late_frame"] = """
  select l.*, coalesce(h.payments_made, 0) as payments_made,
    coalesce(h.late_payments, 0) as late_payments, coalesce(h.late_ratio, 0) as late_ratio,
    c.CREDIT_SCORE
  from loan_full l left join payment_history h on l.LOAN_ID = h.LOAN_ID
  join customers c on l.CUSTOMER_ID = c.CUSTOMER_ID"""

VIEWS["split_loans"] = """
  select f.*, row_number() over (
      partition by f.is_default order by md5(concat_ws(':', cast(f.LOAN_ID as varchar), '42')))
    <= q.quota as is_train
  from default_frame f join (
    select is_default, cast(floor(share) as bigint)
      + case when row_number() over (order by share - floor(share) desc, is_default)
        <= train - sum(cast(floor(share) as bigint)) over () then 1 else 0 end as quota
    from (
      select is_default, train, cast(train * class_rows as double) / all_rows as share
      from (
        select is_default, count(*) as class_rows, sum(count(*)) over () as all_rows,
          sum(count(*)) over () - cast(ceil(sum(count(*)) over () * 0.2) as bigint) as train
        from default_frame group by is_default) a) b) q
  on f.is_default = q.is_default"""

VIEWS["model_scores"] = (
    "select LOAN_ID, label, case when score_pm > 500 then 1 else 0 end as prediction,"
    " score_pm / cast(1000 as double) as score from ("
    + SCORE_SQL.replace("{hex}", ANSI_HEX).replace("{loan}", "loan")
    + ") s"
)

VIEWS["confusion_counts"] = """
  select count(*) filter (where label = 0 and prediction = 0) as tn,
    count(*) filter (where label = 0 and prediction = 1) as fp,
    count(*) filter (where label = 1 and prediction = 0) as fn,
    count(*) filter (where label = 1 and prediction = 1) as tp
  from model_scores"""

VIEWS["class_rates"] = """
  select *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) as f0,
    coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) as f1
  from (
    select coalesce(cast(tn as double) / nullif(tn + fn, 0), 0) as p0,
      coalesce(cast(tn as double) / nullif(tn + fp, 0), 0) as r0, tn + fp as s0,
      coalesce(cast(tp as double) / nullif(tp + fp, 0), 0) as p1,
      coalesce(cast(tp as double) / nullif(tp + fn, 0), 0) as r1, tp + fn as s1,
      cast(tn + tp as double) / (tn + fp + fn + tp) as acc
    from confusion_counts) c"""

VIEWS["score_points"] = """
  select score, pos, neg, sum(pos) over (order by score desc) as cum_pos,
    sum(neg) over (order by score desc) as cum_neg,
    sum(pos) over () as all_pos, sum(neg) over () as all_neg
  from (
    select score, count(*) filter (where label = 1) as pos,
      count(*) filter (where label = 0) as neg
    from model_scores group by score) s"""
