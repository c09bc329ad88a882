"""Table schemas, keys and literal domains of the bank model (fixed values)."""

from __future__ import annotations

from pyspark.sql import types as T

_ID, _FLAG, _TEXT, _DATE = T.LongType(), T.IntegerType(), T.StringType(), T.DateType()
_MONEY, _RATE = T.DecimalType(18, 2), T.DecimalType(6, 2)

# Column names and types of the ten bank tables.
TABLE_COLUMNS: dict[str, dict[str, T.DataType]] = {
    "customers": {
        "CUSTOMER_ID": _ID,
        "CUSTOMER_NAME": _TEXT,
        "ANNUAL_INCOME": T.DoubleType(),
        "CREDIT_SCORE": T.IntegerType(),
        "JOIN_DATE": _DATE,
        "DATE_OF_BIRTH": _DATE,
    },
    "branches": {"BRANCH_ID": _ID, "BRANCH_NAME": _TEXT, "OPENED_DATE": _DATE},
    "employees": {"EMPLOYEE_ID": _ID, "BRANCH_ID": _ID, "HIRE_DATE": _DATE},
    "accounts": {
        "ACCOUNT_ID": _ID,
        "CUSTOMER_ID": _ID,
        "ACCOUNT_TYPE": _TEXT,
        "STATUS": _TEXT,
        "BALANCE": _MONEY,
        "OPEN_DATE": _DATE,
    },
    "cards": {
        "CARD_ID": _ID,
        "CUSTOMER_ID": _ID,
        "CARD_TYPE": _TEXT,
        "CREDIT_LIMIT": _MONEY,
        "ISSUE_DATE": _DATE,
        "EXPIRY_DATE": _DATE,
    },
    "loan": {
        "LOAN_ID": _ID,
        "CUSTOMER_ID": _ID,
        "BRANCH_ID": _ID,
        "LOAN_TYPE": _TEXT,
        "LOAN_AMOUNT": _MONEY,
        "INTEREST_RATE": _RATE,
        "STATUS": _TEXT,
        "START_DATE": _DATE,
    },
    "loan_payment": {
        "PAYMENT_ID": _ID,
        "LOAN_ID": _ID,
        "PAYMENT_AMOUNT": _MONEY,
        "PAYMENT_DATE": _DATE,
        "LATE_PAYMENT_FLAG": _FLAG,
    },
    "transaction_list": {
        "TRANSACTION_ID": _ID,
        "ACCOUNT_ID": _ID,
        "AMOUNT": _MONEY,
        "TXN_DATE": _DATE,
    },
    "card_transaction": {
        "CARD_TXN_ID": _ID,
        "CARD_ID": _ID,
        "MERCHANT_CATEGORY": _TEXT,
        "AMOUNT": _MONEY,
        "TXN_DATE": _DATE,
        "IS_FRAUD": _FLAG,
    },
    "support_ticket": {
        "TICKET_ID": _ID,
        "CUSTOMER_ID": _ID,
        "ISSUE_TYPE": _TEXT,
        "STATUS": _TEXT,
        "DATE_OPENED": _DATE,
        "DATE_RESOLVED": _DATE,
    },
}

TABLES: tuple[str, ...] = tuple(TABLE_COLUMNS)

# The two event-level tables; every other table is a dimension or a small fact.
EVENT_TABLES: tuple[str, ...] = ("transaction_list", "card_transaction")

# Primary key of each table.
KEYS: dict[str, str] = {
    "customers": "CUSTOMER_ID",
    "branches": "BRANCH_ID",
    "employees": "EMPLOYEE_ID",
    "accounts": "ACCOUNT_ID",
    "cards": "CARD_ID",
    "loan": "LOAN_ID",
    "loan_payment": "PAYMENT_ID",
    "transaction_list": "TRANSACTION_ID",
    "card_transaction": "CARD_TXN_ID",
    "support_ticket": "TICKET_ID",
}

# Literal domains the analyses test against.
DEFAULT_STATUSES = ("Defaulted", "Written Off")
ACTIVE_STATUS = "Active"
ACCOUNT_STATUSES = ("Active", "Dormant", "Closed")
RISK_STATUSES = ("dormant", "closed")
SETTLED_TICKET_STATUSES = ("closed", "resolved")
FRAUD_REPORT_ISSUE = "Fraud Report"


def struct_for(table: str) -> T.StructType:
    """Explicit schema of ``table``, so that readers never infer."""
    return T.StructType([T.StructField(n, k) for n, k in TABLE_COLUMNS[table].items()])


def columns_of(table: str, *kinds: type[T.DataType]) -> list[str]:
    """Names of the columns of ``table`` whose type is one of ``kinds`` (all without any)."""
    return [f.name for f in struct_for(table) if not kinds or isinstance(f.dataType, kinds)]


def date_columns(table: str) -> list[str]:
    return columns_of(table, T.DateType)


def text_columns(table: str) -> list[str]:
    return columns_of(table, T.StringType)


def integer_columns(table: str) -> list[str]:
    return columns_of(table, T.LongType, T.IntegerType)


def measure_columns(table: str) -> list[str]:
    """Numeric columns that are no identifiers."""
    numeric = columns_of(table, T.LongType, T.IntegerType, T.DoubleType, T.DecimalType)
    return [c for c in numeric if not c.endswith("_ID")]
