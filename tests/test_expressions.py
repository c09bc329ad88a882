"""Edges of the scalar expressions, one test per trap."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import bands, scalars
from ledgerlens.operators import cleaning
from tests.conftest import day


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expr("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("spec", "values"),
    [
        (bands.CREDIT, [0, 1, 600, 601, 700, 800, 900, 901, None]),
        (bands.UTILIZATION, [0, 0.01, 25, 25.01, 50, 75, 300, 300.01, None]),
        (bands.ACCOUNT_AGE, [0, 1, 365, 366, 730, 3650, 3651, None]),
        (bands.TENURE, [-1, 0, 180, 181, 365, 730, 1825, 10000, 10001, None]),
    ],
)
def test_bands_are_right_closed_and_null_outside(spark, spec, values):
    got = column(spark, [None if v is None else float(v) for v in values], "double", spec.label)
    cut = pd.cut(pd.Series(values, dtype=float), bins=list(spec.edges), labels=list(spec.labels))
    assert got == [None if pd.isna(x) else x for x in cut]


def test_band_needs_matching_edges():
    with pytest.raises(ValueError, match="one more edge"):
        bands.band("v", [0, 1], ["a", "b"])


def test_band_position_follows_the_bands_not_the_spelling(spark):
    labels = list(bands.TENURE.labels)
    assert column(spark, labels, "string", bands.TENURE.position) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize(
    "values",
    [
        [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0],
        [10.0, 10.0, 20.0, 30.0, 30.0, 40.0, 55.5, 60.0, 61.0],
        [3.0, 1.0, 2.0, 9.0, None],
    ],
)
def test_income_quartile_equals_qcut(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.q for r in bands.with_quartile_band(df, "v", "q").orderBy("i").collect()]
    cut = pd.qcut(pd.Series(values, dtype=float), 4, labels=list(bands.QUARTILE_LABELS))
    assert got == [None if pd.isna(x) else x for x in cut]


def test_income_quartile_raises_on_equal_edges(spark):
    df = spark.createDataFrame([(5.0,)] * 8, "v double")
    with pytest.raises(Exception, match="must be unique"):
        bands.with_quartile_band(df, "v", "q").collect()


def test_rounding_is_half_even(spark):
    values = [0.125, 0.375, 2.5, 1.005, -0.125]
    got = column(spark, values, "double", lambda c: scalars.round_even(F.col(c), 2))
    assert got == [float(np.round(v, 2)) for v in values]


def test_rates_agree_with_numpy(spark):
    pairs = [(a, b) for b in range(1, 90) for a in range(b + 1)]
    df = spark.createDataFrame(pairs, "a int, b int")
    got = {(r.a, r.b): r.p for r in df.withColumn("p", scalars.pct("a", "b")).collect()}
    assert got == {(a, b): float(np.round(a / b * 100, 2)) for a, b in pairs}


def test_missing_month_is_a_group_of_its_own(spark):
    got = column(spark, [day("2001-02-03"), None], "date", scalars.month_of)
    assert got == ["2001-02", "NaT"]


def test_days_are_floored(spark):
    moments = [
        ("2001-01-02 01:00:00", "2001-01-01 23:00:00", 0),
        ("2001-01-03 00:00:00", "2001-01-01 23:00:00", 1),
        ("2001-01-01 23:00:00", "2001-01-02 01:00:00", -1),
        ("2001-03-26 00:00:00", "2001-03-25 00:00:00", 1),
        ("2001-01-01 00:00:00.000001", "2000-12-31 00:00:00.000002", 0),
    ]
    rows = [(dt.datetime.fromisoformat(a), dt.datetime.fromisoformat(b)) for a, b, _ in moments]
    for kind in ("timestamp_ntz", "timestamp"):
        df = spark.createDataFrame(rows, f"a {kind}, b {kind}")
        got = [r[0] for r in df.select(scalars.days_between("a", "b")).collect()]
        assert got == [n for _, _, n in moments]


def test_days_ignore_summer_time(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.createDataFrame(
            [(dt.datetime(2001, 3, 26), dt.datetime(2001, 3, 25))],
            "a timestamp_ntz, b timestamp_ntz",
        )
        assert df.select(scalars.days_between("a", "b")).first()[0] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_pure_dates_use_the_short_form(spark):
    df = spark.createDataFrame([(day("2001-01-05"), day("2001-01-01"))], "a date, b date")
    out = df.select(scalars.elapsed_days(df, "a", "b").alias("n"))
    assert out.first().n == 4
    assert "hour(" not in out._jdf.queryExecution().toString()


def test_as_of_defaults_to_the_current_date(spark):
    got = spark.range(1).select(scalars.as_of_date().alias("d"), F.current_date().alias("e")).first()
    assert got.d == got.e
    assert spark.range(1).select(scalars.as_of_date(day("2002-01-01"))).first()[0] == day("2002-01-01")


def test_utilization_is_null_without_a_positive_limit(spark):
    df = spark.createDataFrame(
        [(Decimal(5), Decimal(0)), (Decimal(5), None), (Decimal(5), Decimal(-1)),
         (Decimal(1), Decimal(3))],
        "s decimal(18,2), l decimal(18,2)",
    )
    got = [r[0] for r in df.select(scalars.utilization_pct("s", "l")).collect()]
    assert got == [None, None, None, 33.33]


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a int, b int")
    assert [r[0] for r in df.select(scalars.ratio("a", "b")).collect()] == [None, 0.25]


def test_unknown_status_is_outside_every_list(spark):
    values = ["closed", "Closed", "open", None]
    outside = column(spark, values, "string", lambda c: scalars.not_in(c, ["closed", "resolved"]))
    assert outside == [False, True, True, True]
    inside = column(spark, values, "string", lambda c: scalars.is_in(c, ["closed"]))
    assert inside == [1, 0, 0, 0]


def test_prior_event_counts_the_same_day_and_is_never_null(spark):
    d1, d2 = day("2001-01-01"), day("2001-01-02")
    df = spark.createDataFrame(
        [(d1, d1), (d1, d2), (d2, d1), (None, d1), (d1, None), (None, None)], "m date, e date"
    )
    got = [r[0] for r in df.select(scalars.at_or_after("m", "e")).collect()]
    assert got == [True, False, True, False, False, False]


def test_normalized_text(spark):
    assert column(spark, [" Dormant ", "CLOSED"], "string", scalars.normalized) == [
        "dormant", "closed",
    ]


def test_headers_are_trimmed_and_upper_case(spark):
    df = spark.createDataFrame([(1, 2)], "` card_id ` int, `Card Type` int")
    assert cleaning.clean_headers(df).columns == ["CARD_ID", "CARD TYPE"]


def at(*parts):
    return dt.datetime(*parts)


def test_unreadable_dates_are_null(spark):
    df = spark.createDataFrame(
        [("2001-02-03",), ("garbage",), (None,), ("2001-02-03 04:05:06",)], "START_DATE string"
    )
    got = [r[0] for r in cleaning.parse_dates(df, "loan").collect()]
    assert got == [at(2001, 2, 3), None, None, at(2001, 2, 3, 4, 5, 6)]


def test_dates_are_read_in_every_declared_form(spark):
    texts = ["2020/01/15", "01/15/2020", "15-Jan-2020", "15.1.2020", " 2020-01-15 ", "1/15/2020 07:30"]
    df = spark.createDataFrame([(t,) for t in texts], "START_DATE string")
    got = [r[0] for r in cleaning.parse_dates(df, "loan").collect()]
    assert got == [at(2020, 1, 15)] * 5 + [at(2020, 1, 15, 7, 30)]


def test_text_and_timestamps_give_the_same_days(spark):
    rows_ = [("2024-01-01 23:00", "2024-01-02 01:00"), ("2024-01-01 01:00", "2024-01-02 01:00")]
    df = spark.createDataFrame(rows_, "DATE_OPENED string, DATE_RESOLVED string")
    read = cleaning.parse_dates(df, "support_ticket")
    days = read.select(scalars.elapsed_days(read, "DATE_RESOLVED", "DATE_OPENED").alias("d")).collect()
    assert [r.d for r in days] == [0, 1]


def test_numbers_are_not_rounded_and_failures_are_counted(spark):
    df = spark.createDataFrame(
        [("1", "8.375", "2001-01-01"), ("x", "1000.555", "no day"), (None, "1.123456789", "")],
        "LOAN_ID string, LOAN_AMOUNT string, START_DATE string",
    )
    typed = cleaning.type_columns(df, "loan").collect()
    assert [r.LOAN_ID for r in typed] == [1, None, None]
    assert [r.LOAN_AMOUNT for r in typed] == [Decimal("8.375"), Decimal("1000.555"), None]
    report = {r.column_name: (r.n_values, r.n_unread) for r in cleaning.unread_values(df, "loan").collect()}
    assert report == {"LOAN_ID": (2, 1), "LOAN_AMOUNT": (3, 1), "START_DATE": (2, 1)}


def test_timestamps_keep_their_time(spark):
    df = spark.createDataFrame([(dt.datetime(2001, 1, 1, 5),)], "START_DATE timestamp_ntz")
    assert cleaning.parse_dates(df, "loan").first()[0] == dt.datetime(2001, 1, 1, 5)


def test_integers_take_the_narrowest_type(spark):
    df = spark.createDataFrame(
        [(1, 200, 70000, 2**40, 1), (-128, -1, 1, 1, 1)],
        "a bigint, b bigint, c bigint, d bigint, e int",
    )
    assert [k for _, k in cleaning.narrow_ints(df).dtypes] == [
        "tinyint", "smallint", "int", "bigint", "tinyint",
    ]


def test_only_doubles_become_floats(spark):
    df = spark.createDataFrame([(1.5, Decimal("2.25"))], "a double, m decimal(18,2)")
    assert [k for _, k in cleaning.narrow_floats(df).dtypes] == ["float", "decimal(18,2)"]


def test_cardinality_rule(spark):
    many = spark.range(5000).select(F.col("id").cast("string").alias("t"), F.lit("x").alias("u"))
    for approx in (False, True):
        got = {
            r.column_name: r.low_cardinality
            for r in cleaning.text_cardinality({"many": many}, approx).collect()
        }
        assert got == {"t": False, "u": True}


def test_a_column_of_dates_is_read_by_one_form(spark):
    days = [dt.date(2020, 2, 13), dt.date(2020, 3, 4), dt.date(1999, 12, 31)]
    forms = {
        "ISO 8601": "%Y-%m-%d", "d/M/yyyy": "%d/%m/%Y", "M/d/yyyy": "%m/%d/%Y",
        "MMM d, yyyy": "%b %d, %Y", "yyyyMMdd": "%Y%m%d", "d-MMM-yyyy": "%d-%b-%Y",
        "yyyy/M/d": "%Y/%m/%d", "d.M.yyyy": "%d.%m.%Y",
    }
    names = [f"c{i}" for i in range(len(forms))]
    rows = [[d.strftime(f) for f in forms.values()] for d in days]
    rows += [["unknown"] * len(forms), [""] * len(forms), [None] * len(forms)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    found = {r.column_name: r for r in cleaning.date_forms(df, names).collect()}
    assert [found[n].form for n in names] == list(forms)
    assert all((r.n_values, r.n_read, r.ambiguous) == (4, 3, False) for r in found.values())
    for row, day in zip(cleaning.read_dates(df, names).collect(), [*days, None, None, None]):
        assert all((v.date() if v else None) == day for v in row)


def test_day_and_month_that_cannot_be_told_apart(spark):
    rows = [("03/04/2020", "04/04/2020", "x", "03/04/2020 10:30"), ("01/02/2021", "05/05/2020", None, "13/04/2020 0:05:06")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    found = {r.column_name: (r.form, r.ambiguous) for r in cleaning.date_forms(df, list("abcd")).collect()}
    # Both forms read the same days in b, so nothing is unclear there.
    assert found == {"a": ("d/M/yyyy", True), "b": ("d/M/yyyy", False), "c": (None, False), "d": ("d/M/yyyy", False)}
    read = cleaning.read_dates(df, list("abcd")).first()
    assert read.a == dt.datetime(2020, 4, 3) and read.d == dt.datetime(2020, 4, 3, 10, 30) and read.c is None
    american = cleaning.read_dates(df, ["a"], ("M/d/yyyy", "d/M/yyyy")).first()
    assert american.a == dt.datetime(2020, 3, 4)
    with pytest.raises(ValueError):
        cleaning.read_dates(df, ["a"], ambiguous="raise")
