"""Cross tables in percent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import pct

OTHER = "OTHER"


def crosstab_counts(df: DataFrame, row: str, column: str) -> DataFrame:
    """Rows per combination, without rows that lack either key."""
    return (
        df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(row, column)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def crosstab_pct(counts: DataFrame, row: str, column: str, by: str = "row") -> DataFrame:
    """Long form: share of each observed combination in its row or in its column.

    ``counts`` may hold several rows per combination (partial counts of an earlier step).
    """
    cells = counts.groupBy(row, column).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W.partitionBy(row if by == "row" else column))
    return cells.withColumn("pct", pct(F.col("n"), total))


def crosstab_matrix(
    counts: DataFrame, row: str, column: str, values: Sequence, names: Sequence[str],
    by: str = "row",
) -> DataFrame:
    """Wide form: one percentage column per value of ``column``, 0 where none was seen.

    The values are given, so no extra job looks for them. Anything else is kept in a last column
    ``OTHER`` for text values, so that a row always adds up to 100.
    """
    label = F.col(column)
    values, names = list(values), list(names)
    if not isinstance(values[0], bool):
        label = F.when(label.isin(*values), label).otherwise(F.lit(OTHER))
        values, names = [*values, OTHER], [*names, OTHER.lower() + "_pct"]
    cells = counts.groupBy(F.col(row), label.alias("_label")).agg(F.sum("n").alias("n"))
    if by == "row":
        wide = cells.groupBy(row).pivot("_label", values).agg(F.sum("n"))
        cell = [F.coalesce(F.col(f"`{_text(v)}`"), F.lit(0)) for v in values]
        total = sum(cell[1:], cell[0])
        return wide.select(row, *(pct(c, total).alias(n) for c, n in zip(cell, names)))
    shares = cells.withColumn("_pct", pct(F.col("n"), F.sum("n").over(W.partitionBy("_label"))))
    wide = shares.groupBy(row).pivot("_label", values).agg(F.first("_pct"))
    return wide.select(
        row,
        *(
            F.coalesce(F.col(f"`{_text(v)}`"), F.lit(0.0)).alias(n)
            for v, n in zip(values, names)
        ),
    )


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)
