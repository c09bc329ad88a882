"""Header, date and type cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.schema import date_columns, struct_for

# Bounds of the integer types, narrowest first.
INTEGER_BOUNDS = (
    ("tinyint", -(2**7), 2**7 - 1),
    ("smallint", -(2**15), 2**15 - 1),
    ("int", -(2**31), 2**31 - 1),
)
# A text column is low-cardinality below max(CATEGORY_FLOOR, CATEGORY_SHARE * rows) values.
CATEGORY_FLOOR = 1000
CATEGORY_SHARE = 0.3


def clean_headers(df: DataFrame) -> DataFrame:
    """Trim and upper-case the column names."""
    return df.toDF(*(name.strip().upper() for name in df.columns))


# Forms a date may have besides ISO 8601, tried in this order; each with or without a time.
DATE_FORMATS = ("yyyy/M/d", "M/d/yyyy", "d-MMM-yyyy", "d.M.yyyy")
TIME_FORMATS = ("", " H:mm:ss", " H:mm")


def read_date(value: Column | str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Timestamp of a text in ISO form or one of ``formats``; what cannot be read is null.

    The time of day is kept: two days apart and 26 hours apart are not the same.
    """
    value = F.trim(F.col(value) if isinstance(value, str) else value)
    ways = [F.try_to_timestamp(value)]
    ways += [F.try_to_timestamp(value, F.lit(d + t)) for d in formats for t in TIME_FORMATS]
    return F.coalesce(*ways)


# Forms a whole column may have, besides ISO 8601: day or month first, names, no separators.
COLUMN_FORMATS = (
    "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "d.M.yyyy", "d-MMM-yyyy", "d MMM yyyy",
    "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd",
)
ISO = "ISO 8601"
# Texts that stock readers of other forms would take for a year or a number of seconds.
_ISO_SHAPE = r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2}([ T].*)?)?$"


def _read_as(value: Column, form: str) -> Column:
    """Timestamp of a text in one form, with or without a time of day."""
    value = F.trim(value)
    if form == ISO:
        return F.when(value.rlike(_ISO_SHAPE), F.try_to_timestamp(value))
    return F.coalesce(*(F.try_to_timestamp(value, F.lit(form + t)) for t in TIME_FORMATS))


def date_forms(
    df: DataFrame, columns: Sequence[str], formats: Sequence[str] = COLUMN_FORMATS
) -> DataFrame:
    """Which form the dates of each text column have, decided by the whole column in one pass.

    One row per column: ``column_name``, ``n_values``, ``form`` (the one that reads most values, ISO
    first, then in the order of ``formats``; null where none reads any), ``n_read`` by that form, and
    ``ambiguous``: another form reads as many values, and at least one of them as another day.
    """
    forms = [ISO, *formats]
    measures, parts = [], []
    for i, name in enumerate(columns):
        text = F.nullif(F.trim(F.col(name)), F.lit(""))
        measures.append(F.count(text).alias(f"n_{i}"))
        read = [_read_as(text, form) for form in forms]
        for k, day in enumerate(read):
            measures.append(F.count(day).alias(f"r_{i}_{k}"))
            # Pairs of forms that read some value as different days; a few of them per column.
            for j in range(k):
                measures.append(F.max((day != read[j]).cast("int")).alias(f"d_{i}_{j}_{k}"))
        counts = [F.col(f"r_{i}_{k}") for k in range(len(forms))]
        most = F.greatest(*counts)
        best = F.lit(None).cast("int")
        for k in reversed(range(len(forms))):
            best = F.when((counts[k] == most) & (most > 0), k).otherwise(best)
        rivals = F.lit(False)
        for k in range(len(forms)):
            for j in range(k):
                apart = (F.col(f"d_{i}_{j}_{k}") == 1) & (counts[j] == most) & (counts[k] == most)
                rivals = rivals | (F.coalesce(apart, F.lit(False)) & (best == j))
        parts.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.col(f"n_{i}").alias("n_values"),
                F.get(F.array(*map(F.lit, forms)), best).alias("form"),
                most.alias("n_read"),
                F.coalesce(rivals, F.lit(False)).alias("ambiguous"),
            )
        )
    found = df.agg(*measures)
    return found.select(F.explode(F.array(*parts)).alias("part")).select("part.*")


def read_dates(
    df: DataFrame, columns: Sequence[str], formats: Sequence[str] = COLUMN_FORMATS,
    ambiguous: str = "first",
) -> DataFrame:
    """Text columns as timestamps, each by the one form that ``date_forms`` finds for it.

    A value that the form of its column does not read is null. Where two forms read a column
    alike but differ in a day, the earlier one in the order counts, or the call raises with
    ``ambiguous="raise"``. One row per column comes to the driver.
    """
    found = date_forms(df, columns, formats).collect()
    unclear = [r.column_name for r in found if r.ambiguous]
    if unclear and ambiguous == "raise":
        raise ValueError(f"day and month cannot be told apart in: {', '.join(unclear)}")
    fixes = {
        r.column_name: _read_as(F.col(r.column_name), r.form)
        if r.form else F.lit(None).cast("timestamp")
        for r in found
    }
    return df.withColumns(fixes) if fixes else df


def read_number(value: Column | str, kind: T.DataType) -> Column:
    """Number of a text; what is no number of that kind is null.

    Amounts are rounded half up to eight decimals, however many digits they are written with and
    also in scientific notation, so rates such as 8.375 stay as they are. An integer may be
    written as a float without a fraction, such as 12.0 or 1e+16.
    """
    value = F.trim(F.col(value) if isinstance(value, str) else value)
    if isinstance(kind, T.DecimalType):
        return value.try_cast(EXACT_AMOUNT)
    found = value.try_cast(kind)
    if isinstance(kind, T.IntegralType):
        exact = value.try_cast("decimal(38,18)")
        found = F.coalesce(found, F.when(exact == F.floor(exact), exact.try_cast(kind)))
    return found


EXACT_AMOUNT = "decimal(26,8)"


def type_columns(df: DataFrame, table: str, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Give the columns of ``table`` that are stored as text their declared kind.

    Dates become timestamps. Columns that are typed already, and unknown ones, stay as they are.
    """
    known = {f.name: f.dataType for f in struct_for(table)}
    fixes = {}
    for name, stored in df.dtypes:
        kind = known.get(name)
        if stored != "string" or kind is None or isinstance(kind, T.StringType):
            continue
        dated = isinstance(kind, (T.DateType, T.TimestampType))
        fixes[name] = read_date(name, formats) if dated else read_number(name, kind)
    return df.withColumns(fixes) if fixes else df


def parse_dates(df: DataFrame, table: str, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Read the known date columns of ``table`` that are stored as text, time of day included."""
    kinds = dict(df.dtypes)
    names = [n for n in date_columns(table) if kinds.get(n) == "string"]
    return df.withColumns({n: read_date(n, formats) for n in names}) if names else df


def unread_values(raw: DataFrame, table: str, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Per column of a text table: values that are there, and those that cannot be read."""
    names = raw.columns
    text = raw.select([F.nullif(F.trim(c), F.lit("")).alias(c) for c in names])
    typed = type_columns(text.withColumn("_row", F.struct(*names)), table, formats)
    found = typed.agg(
        *[F.count(F.col("_row")[c]).alias(f"n_{i}") for i, c in enumerate(names)],
        *[
            F.count_if(F.col("_row")[c].isNotNull() & F.col(c).isNull()).alias(f"u_{i}")
            for i, c in enumerate(names)
        ],
    )
    parts = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"n_{i}").alias("n_values"),
            F.col(f"u_{i}").alias("n_unread"),
        )
        for i, c in enumerate(names)
    ]
    return found.select(F.explode(F.array(*parts)).alias("part")).select("part.*")


def _narrowest(low: Column, high: Column, wide: str) -> Column:
    kind = F.when(low.isNull(), F.lit(wide))
    for name, least, most in INTEGER_BOUNDS:
        kind = kind.when((low >= least) & (high <= most), F.lit(name))
    return kind.otherwise(F.lit("bigint"))


def narrow_int_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row with, per integer column, the narrowest type that holds all its values."""
    kinds = dict(df.dtypes)
    if columns is None:
        columns = [n for n, k in kinds.items() if k in ("bigint", "int", "smallint")]
    return df.agg(
        *(
            _narrowest(F.min(c).cast("bigint"), F.max(c).cast("bigint"), kinds[c]).alias(c)
            for c in columns
        )
    )


def narrow_ints(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast integer columns to the narrowest fitting type; one pass collects one row of types."""
    types = narrow_int_types(df, columns).first().asDict()
    return df.withColumns({name: F.col(name).cast(kind) for name, kind in types.items()})


def narrow_floats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast double columns to float. Opt-in: float sums lose cents, so never use it on money."""
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({name: F.col(name).cast("float") for name in columns})


def text_cardinality(
    frames: Mapping[str, DataFrame], approx: bool = False
) -> DataFrame:
    """Per text column: distinct values and whether it counts as low-cardinality.

    Exact by default. ``approx`` uses a sketch instead, in one pass without expanding rows.
    """
    count = F.approx_count_distinct if approx else F.count_distinct
    pieces = []
    for table, df in frames.items():
        columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        if not columns:
            continue
        wide = df.agg(
            F.count(F.lit(1)).alias("n_rows"), *(count(F.col(c)).alias(c) for c in columns)
        )
        long = wide.unpivot("n_rows", columns, "column_name", "n_distinct")
        pieces.append(long.withColumn("table_name", F.lit(table)))
    report = pieces[0]
    for piece in pieces[1:]:
        report = report.unionByName(piece)
    limit = F.greatest(F.lit(float(CATEGORY_FLOOR)), F.col("n_rows") * CATEGORY_SHARE)
    return report.select(
        "table_name",
        "column_name",
        "n_rows",
        "n_distinct",
        (F.col("n_distinct") < limit).alias("low_cardinality"),
    )
