"""The ten bank tables as views over the generic test tables, for Spark and for the SQL check.

One SQL text per table reads the same in Spark and in an ANSI database. Names in braces are
source tables.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.bank import Bank

# Fixed value: "today" of every query on the test tables.
AS_OF = dt.date(2002, 1, 1)

# Schemas of the source tables the views read.
SOURCE_DDL = {
    "customer": "c_custkey bigint, c_name string, c_acctbal double",
    "supplier": "s_suppkey bigint, s_name string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_extendedprice double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, user_id bigint, event_type string",
}

_LINE_ID = "((l_orderkey*10+l_linenumber)*100000+l_partkey)*10000+l_suppkey"

# Definition of the bank tables on the test data.
TABLE_SQL = {
    "customers": """
        select c_custkey as CUSTOMER_ID, c_name as CUSTOMER_NAME,
          (c_acctbal+1000.0)*100 as ANNUAL_INCOME,
          cast(300+(c_custkey*7919)%601 as int) as CREDIT_SCORE,
          date '1988-01-01' + cast(c_custkey%1800 as int) as JOIN_DATE,
          date '1940-01-01' + cast((c_custkey*53)%16000 as int) as DATE_OF_BIRTH
        from {customer}""",
    "branches": """
        select s_suppkey as BRANCH_ID, s_name as BRANCH_NAME,
          date '1980-01-01' + cast((s_suppkey*97)%5000 as int) as OPENED_DATE
        from {supplier}""",
    "employees": """
        select s_suppkey as EMPLOYEE_ID, s_suppkey as BRANCH_ID,
          date '1985-01-01' + cast((s_suppkey*61)%5000 as int) as HIRE_DATE
        from {supplier}""",
    "accounts": """
        select o_orderkey as ACCOUNT_ID, o_custkey as CUSTOMER_ID,
          case o_orderpriority when '1-URGENT' then 'Savings' when '2-HIGH' then 'Current'
            when '3-MEDIUM' then 'Salary' when '4-NOT SPECIFIED' then 'Fixed Deposit'
            else 'NRI' end as ACCOUNT_TYPE,
          case o_orderstatus when 'O' then 'Active' when 'P' then 'Dormant'
            else 'Closed' end as STATUS,
          cast(o_totalprice as decimal(18,2)) as BALANCE,
          cast(o_orderdate as date) as OPEN_DATE
        from {orders} where o_orderkey%5=0""",
    "cards": """
        select o_orderkey as CARD_ID, o_custkey as CUSTOMER_ID,
          case o_orderpriority when '1-URGENT' then 'Platinum' when '2-HIGH' then 'Gold'
            when '3-MEDIUM' then 'Credit' else 'Debit' end as CARD_TYPE,
          case when o_orderpriority='5-LOW' then cast(0 as decimal(18,2))
            else cast(o_totalprice as decimal(18,2)) end as CREDIT_LIMIT,
          cast(o_orderdate as date) as ISSUE_DATE,
          cast(o_orderdate as date)+1461 as EXPIRY_DATE
        from {orders} where o_orderkey%5 in (1,2)""",
    "loan": """
        select o_orderkey as LOAN_ID, o_custkey as CUSTOMER_ID,
          o_custkey%(select count(*) from {supplier}) as BRANCH_ID,
          case o_orderpriority when '1-URGENT' then 'Home' when '2-HIGH' then 'Auto'
            when '3-MEDIUM' then 'Personal' when '4-NOT SPECIFIED' then 'Education'
            else 'Business' end as LOAN_TYPE,
          cast(o_totalprice as decimal(18,2)) as LOAN_AMOUNT,
          cast(6+((o_orderkey*31)%900)/100.0 as decimal(6,2)) as INTEREST_RATE,
          case when (o_orderkey*13+o_custkey)%17=0 then 'Defaulted'
            when (o_orderkey*7+o_custkey)%29=0 then 'Written Off'
            when o_orderstatus='F' then 'Closed' else 'Active' end as STATUS,
          cast(o_orderdate as date) as START_DATE
        from {orders} where o_orderkey%5 in (3,4)""",
    "loan_payment": f"""
        select {_LINE_ID} as PAYMENT_ID, l_orderkey as LOAN_ID,
          cast(l_extendedprice as decimal(18,2)) as PAYMENT_AMOUNT,
          cast(l_shipdate as date) as PAYMENT_DATE,
          case when l_returnflag='R' and l_linestatus='F' then 1 else 0 end as LATE_PAYMENT_FLAG
        from {{lineitem}} where l_orderkey%5 in (3,4)""",
    "transaction_list": f"""
        select {_LINE_ID} as TRANSACTION_ID, l_orderkey as ACCOUNT_ID,
          cast(l_extendedprice as decimal(18,2)) as AMOUNT,
          cast(l_shipdate as date) as TXN_DATE
        from {{lineitem}} where l_orderkey%5=0""",
    "card_transaction": f"""
        select {_LINE_ID} as CARD_TXN_ID, l_orderkey as CARD_ID,
          case l_partkey%6 when 0 then 'Grocery' when 1 then 'Travel' when 2 then 'Electronics'
            when 3 then 'Fuel' when 4 then 'Dining' else 'Online' end as MERCHANT_CATEGORY,
          cast(l_extendedprice as decimal(18,2)) as AMOUNT,
          cast(l_shipdate as date) as TXN_DATE,
          case when (l_orderkey*31+l_partkey*17+l_suppkey)%23=0
            or (l_extendedprice>90000 and l_partkey%6=1 and l_suppkey%5=0)
            then 1 else 0 end as IS_FRAUD
        from {{lineitem}} where l_orderkey%5 in (1,2)""",
    "support_ticket": """
        select event_id as TICKET_ID, user_id as CUSTOMER_ID,
          case event_type when 'click' then 'Card Issue' when 'view' then 'Fraud Report'
            when 'purchase' then 'Loan Query' when 'signup' then 'KYC'
            else 'Other' end as ISSUE_TYPE,
          case event_id%4 when 0 then 'open' when 1 then 'escalated' when 2 then 'closed'
            else 'resolved' end as STATUS,
          date '1995-01-01' + cast((event_id*37)%2400 as int) as DATE_OPENED,
          case when event_id%4 in (2,3)
            then date '1995-01-01' + cast((event_id*37)%2400 + event_id%15 as int)
            end as DATE_RESOLVED
        from {events}""",
}

# A fixed score per loan in per mille, for metrics the SQL check can follow.
SCORE_SQL = """
    select LOAN_ID,
      case when STATUS in ('Defaulted','Written Off') then 1 else 0 end as label,
      cast(cast({hex} as bigint)%700
        + case when STATUS in ('Defaulted','Written Off') then 300 else 0 end as int) as score_pm
    from {loan}"""
_DIGEST = "substr(md5(concat(cast(LOAN_ID as {text}),':s')),1,8)"
SPARK_HEX = f"conv({_DIGEST.format(text='string')},16,10)"
ANSI_HEX = f"('0x'||{_DIGEST.format(text='varchar')})"


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SOURCE_DDL[table]).parquet(f"{sf_dir}/{table}.parquet")


def bank_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    sql = TABLE_SQL[table]
    frames = {s: source(spark, sf_dir, s) for s in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **frames)


def bank_on(spark: SparkSession, sf_dir: str) -> Bank:
    return Bank(lambda table: bank_table(spark, sf_dir, table), spark)


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, label, prediction, score): the fixed score as a probability."""
    sql = SCORE_SQL.replace("{hex}", SPARK_HEX)
    return spark.sql(sql, loan=bank_table(spark, sf_dir, "loan")).selectExpr(
        "LOAN_ID", "label", "cast(score_pm > 500 as int) as prediction", "score_pm/1000D as score"
    )
