"""Queries on sources, sinks and the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.registry import exports
from ledgerlens.registry.core import Context, query
from ledgerlens.schema import TABLES, struct_for
from ledgerlens.sources import catalog, files, local
from ledgerlens.sources.scratch import new_folder

# The tables below the bank views.
GIVEN = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")

COUNTS_SQL = " union all ".join(
    f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in TABLES
)
CARDS_SQL = """
  select CARD_ID, CUSTOMER_ID, CARD_TYPE, cast(CREDIT_LIMIT as double) as CREDIT_LIMIT,
    ISSUE_DATE, EXPIRY_DATE from cards"""
LOAN_SQL = """
  select LOAN_ID, CUSTOMER_ID, BRANCH_ID, LOAN_TYPE, cast(LOAN_AMOUNT as double) as LOAN_AMOUNT,
    cast(INTEREST_RATE as double) as INTEREST_RATE, STATUS, START_DATE from loan"""
CARD_TRANSACTION_SQL = """
  select CARD_TXN_ID, CARD_ID, MERCHANT_CATEGORY, cast(AMOUNT as double) as AMOUNT, TXN_DATE,
    IS_FRAUD from card_transaction"""


def as_dates(df: DataFrame) -> DataFrame:
    """Timestamps as dates, as the test tables hold no times."""
    return df.select(
        *(F.to_date(c).alias(c) if k.startswith("timestamp") else c for c, k in df.dtypes)
    )


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison across engines."""
    return df.select(
        *(F.col(c).cast("double").alias(c) if k.startswith("decimal") else c for c, k in df.dtypes)
    )


def _weight(column: T.StructField) -> str:
    """SQL, the same in both engines, for a number that depends on the value of a column."""
    name, kind = column.name, column.dataType
    if isinstance(kind, T.StringType):
        return f"length({name})"
    if isinstance(kind, T.DateType):
        return f"year({name}) * 400 + month({name}) * 32 + day({name})"
    if isinstance(kind, T.IntegralType):
        return f"{name} % 1000003"
    return f"cast(floor({name}) as bigint) % 1000003"


def _content(table: str) -> str:
    """Rows, and per column the values that are there and what they add up to."""
    return ", ".join(
        ["count(*) as n_rows"]
        + [f"count({c.name}) as n_{i}, cast(sum({_weight(c)}) as bigint) as s_{i}"
           for i, c in enumerate(struct_for(table))]
    )


WIDEST = max(len(struct_for(t)) for t in TABLES)
CONTENT = ["n_rows", *(f"{x}_{i}" for i in range(WIDEST) for x in "ns")]


def _padded(table: str) -> str:
    own = len(struct_for(table))
    extra = [f"cast(null as bigint) as {x}_{i}" for i in range(own, WIDEST) for x in "ns"]
    return ", ".join([f"'{table}' as table_name", _content(table), *extra])


@query("src_parquet", " union all ".join(f"select {_padded(t)} from {t}" for t in TABLES))
def src_parquet(context: Context) -> DataFrame:
    """What every column of every table holds after it was written and read again."""
    folder = exports.parquet_folder(context)
    scans = []
    for table in TABLES:
        view = f"ledgerlens_written_{table}"
        files.read_parquet(context.spark, f"{folder}/{table}.parquet", table).createOrReplaceTempView(view)
        scans.append(context.spark.sql(f"select {_padded(table)} from {view}"))
    return reduce(DataFrame.unionByName, scans)


@query(
    "src_csv",
    """select ACCOUNT_ID, CUSTOMER_ID, ACCOUNT_TYPE, STATUS, cast(BALANCE as double) as BALANCE,
      OPEN_DATE from accounts""",
)
def src_csv(context: Context) -> DataFrame:
    path = exports.csv_path(context, "accounts")
    return plain(as_dates(files.read_csv(context.spark, path, "accounts")))


@query(
    "src_csv_gz",
    """select TRANSACTION_ID, ACCOUNT_ID, cast(AMOUNT as double) as AMOUNT, TXN_DATE
      from transaction_list""",
)
def src_csv_gz(context: Context) -> DataFrame:
    path = exports.csv_path(context, "transaction_list")
    spread = context.spark.sparkContext.defaultParallelism
    return plain(as_dates(files.read_csv(context.spark, path, "transaction_list", partitions=spread)))


@query(
    "src_csv_gz_members",
    """select CARD_TXN_ID, CARD_ID, cast(AMOUNT as double) as AMOUNT, TXN_DATE, IS_FRAUD
      from card_transaction""",
)
def src_csv_gz_members(context: Context) -> DataFrame:
    """Gzip files whose members are found first and then read apart from each other."""
    path = exports.csv_path(context, "card_transaction")
    fields = files.read_csv(context.spark, path, "card_transaction", members=True)
    wanted = ["CARD_TXN_ID", "CARD_ID", "AMOUNT", "TXN_DATE", "IS_FRAUD"]
    return plain(as_dates(fields.select(*wanted)))


@query("src_csv_torn", "select doc_id, text, lang, source, n_chars from documents")
def src_csv_torn(context: Context) -> DataFrame:
    """Texts with quotes and line breaks from a CSV export whose blocks are read on their own."""
    folder = f"{new_folder(context.spark, 'torn')}/documents.csv"
    given = files.read_parquet(context.spark, f"{context.sf_dir}/documents.parquet")
    files.write_csv(given.select("doc_id", "text", "lang", "source", "n_chars"), folder)
    fields = files.read_text_fields(context.spark, folder, multiline=True)
    return fields.select(
        *(F.col(c).cast(t) for c, t in given.select(*fields.columns).dtypes)
    )


@query("src_warehouse", LOAN_SQL)
def src_warehouse(context: Context) -> DataFrame:
    """Full-table extract; the test tables stand in for a warehouse, which may not run here."""
    return plain(context["loan"])


@query("src_catalog", CARDS_SQL)
def src_catalog(context: Context) -> DataFrame:
    name = f"{exports.database(context)}.cards_source"
    catalog.save_table(context["cards"], name)
    return plain(catalog.read_table(context.spark, name))


@query("src_from_local", COUNTS_SQL)
def src_from_local(context: Context) -> DataFrame:
    """The row counts, ten driver-side rows, made a distributed table again."""
    counts = catalog.row_counts(context.bank).collect()
    rows = [(r.table_name, r.n_rows) for r in counts]
    return local.from_local(context.spark, rows, "table_name string, n_rows bigint")


@query(
    "cat_create_db",
    f"select '{exports.DATABASE}' as namespace, (select count(*) from branches) as n_rows",
)
def cat_create_db(context: Context) -> DataFrame:
    """The database as the catalog lists it, with the rows of a table saved into it."""
    name = exports.database(context)
    catalog.save_table(context["branches"], f"{name}.branches_listed")
    saved = catalog.read_table(context.spark, f"{name}.branches_listed")
    rows = saved.agg(F.count(F.lit(1)).alias("n_rows")).scalar()
    return catalog.show_database(context.spark, name).select("namespace", rows.alias("n_rows"))


@query("sink_table", LOAN_SQL)
def sink_table(context: Context) -> DataFrame:
    """A managed table written over an older version of itself, read back."""
    name = f"{exports.database(context)}.loan_sink"
    catalog.save_table(context["branches"], name)
    catalog.save_table(context["loan"], name)
    return plain(catalog.read_table(context.spark, name))


@query("sink_parquet", CARD_TRANSACTION_SQL)
def sink_parquet(context: Context) -> DataFrame:
    path = f"{new_folder(context.spark, 'sink')}/card_transaction.parquet"
    files.write_parquet(
        context["card_transaction"], path, files.codec_for("card_transaction")
    )
    return plain(files.read_parquet(context.spark, path, "card_transaction"))


@query(
    "ingest_all",
    f"""select table_name, n_rows, 'ok' as status, cast(null as varchar) as error
      from ({COUNTS_SQL}) c""",
)
def ingest_all(context: Context) -> DataFrame:
    loaders = {t: (lambda t=t: context[t]) for t in TABLES}
    return catalog.ingest_all(context.spark, loaders, exports.database(context))


@query("convert_report")
def convert_report(context: Context) -> DataFrame:
    sources = {t: exports.csv_path(context, t) for t in TABLES}
    return files.convert_to_parquet(
        context.spark, sources, new_folder(context.spark, "converted"),
        partitions=context.spark.sparkContext.defaultParallelism,
    )


@query(
    "convert_report_rows",
    f"select table_name, n_rows, true as has_sizes, true as status_fits from ({COUNTS_SQL}) c",
)
def convert_report_rows(context: Context) -> DataFrame:
    """What is determined of ``convert_report``: rows per table, and a status that follows the size."""
    large = F.col("parquet_mb") > files.LARGE_MB
    status = F.when(large, "still large").otherwise("OK")
    return convert_report(context).select(
        "table_name",
        "n_rows",
        ((F.col("source_mb") > 0) & (F.col("parquet_mb") > 0)).alias("has_sizes"),
        (F.col("status") == status).alias("status_fits"),
    )


@query("cat_row_counts", COUNTS_SQL)
def cat_row_counts(context: Context) -> DataFrame:
    return catalog.row_counts(context.bank)


@query("agg_total_rows", f"select cast(sum(n_rows) as bigint) as total_rows from ({COUNTS_SQL}) c")
def agg_total_rows(context: Context) -> DataFrame:
    return catalog.total_rows(context.bank)


@query(
    "src_registry_check",
    " union all ".join(
        f"select '{t}' as table_name, true as present, count(*) as n_rows from {t}" for t in GIVEN
    ),
)
def src_registry_check(context: Context) -> DataFrame:
    """The tables the test bank is made of: is each there, and how many rows does it hold?"""
    report = files.registry_report(context.spark, context.sf_dir, GIVEN)
    counts = catalog.row_counts(
        {t: files.read_parquet(context.spark, f"{context.sf_dir}/{t}.parquet") for t in GIVEN}
    )
    return report.join(counts, "table_name", "left").select("table_name", "present", "n_rows")
