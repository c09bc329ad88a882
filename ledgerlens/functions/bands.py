"""Right-closed banding ``(low, high]``; values outside every band stay null."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.quantiles import approx_quantiles, exact_quantiles, with_scalar
from ledgerlens.functions.scalars import col


@dataclass(frozen=True)
class Bands:
    """``len(edges) == len(labels) + 1``; label *i* covers ``(edges[i], edges[i + 1]]``."""

    edges: tuple[float, ...]
    labels: tuple[str, ...]

    def label(self, value: Column | str) -> Column:
        return band(value, self.edges, self.labels)

    def position(self, label: Column | str) -> Column:
        """Sort key of a label: its place among the bands, not its spelling."""
        return F.array_position(F.lit(list(self.labels)), col(label)).cast("int")


# Band edges and labels of the analyses.
TENURE = Bands((-1, 180, 365, 730, 1825, 10000), ("<6m", "6-12m", "1-2y", "2-5y", "5y+"))
CREDIT = Bands((0, 600, 700, 800, 900), ("<600", "600-700", "700-800", "800+"))
UTILIZATION = Bands((0, 25, 50, 75, 300), ("0-25%", "25-50%", "50-75%", "75%+"))
ACCOUNT_AGE = Bands((0, 365, 730, 3650), ("0-1yr", "1-2yr", "2yr+"))
QUARTILE_LABELS = ("Q1", "Q2", "Q3", "Q4")


def band(
    value: Column | str, edges: Sequence[float | Column], labels: Sequence[str]
) -> Column:
    """Label of the band that holds ``value``."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    value = col(value)
    cases = [
        ((value > low) & (value <= high), label)
        for low, high, label in zip(edges, edges[1:], labels)
    ]
    expr = F.when(cases[0][0], cases[0][1])
    for inside, label in cases[1:]:
        expr = expr.when(inside, label)
    return expr


def quartile_edges(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """One row ``edges`` = struct(low, q25, q50, q75, high) of the non-null values.

    The exact edges are interpolated linearly. Equal-frequency bands cannot be told apart when two
    edges coincide, so that case raises when the query runs.
    """
    find = approx_quantiles if approx else exact_quantiles
    found = find(df, column, (0.0, 0.25, 0.5, 0.75, 1.0))
    names = ("low", "q25", "q50", "q75", "high")
    values = [F.col("quantiles")[i] for i in range(5)]
    clash = values[0] == values[1]
    for left, right in zip(values[1:], values[2:]):
        clash = clash | (left == right)
    message = F.lit(f"bin edges of {column} must be unique")
    return found.select(
        F.when(clash, F.raise_error(message).cast("struct<" + ",".join(
            f"{n}:double" for n in names) + ">"))
        .otherwise(F.struct(*(v.alias(n) for v, n in zip(values, names))))
        .alias("edges")
    )


def with_quartile_band(
    df: DataFrame, column: str, name: str, approx: bool = False
) -> DataFrame:
    """Add the quartile label of ``column``; the lowest value belongs to Q1."""
    value, edges = F.col(column), F.col("_edges")
    label = (
        F.when(value <= edges["q25"], QUARTILE_LABELS[0])
        .when(value <= edges["q50"], QUARTILE_LABELS[1])
        .when(value <= edges["q75"], QUARTILE_LABELS[2])
        .when(value <= edges["high"], QUARTILE_LABELS[3])
    )
    bound = with_scalar(df, "_edges", quartile_edges(df, column, approx))
    return bound.withColumn(name, label).drop("_edges")
