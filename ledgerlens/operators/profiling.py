"""Table profiles: first rows, shape, columns, distribution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.quantiles import column_quantiles, sketch
from ledgerlens.functions.scalars import mean

QUARTILES = (0.25, 0.5, 0.75)


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows by ``order``: a top-n per partition, then one merge."""
    return df.orderBy(*order).limit(n)


def _as_text(field: T.StructField) -> Column:
    value = F.col(field.name)
    if isinstance(field.dataType, T.DoubleType):
        value = value.cast("decimal(38,2)")
    return value.cast("string")


def head_all(frames: Mapping[str, DataFrame], keys: Mapping[str, str], n: int = 5) -> DataFrame:
    """First rows of every table in one frame: key and the row rendered as text."""
    pieces = [
        head(df, [keys[table], *(c for c in df.columns if c != keys[table])], n).select(
            F.lit(table).alias("table_name"),
            F.col(keys[table]).alias("row_key"),
            F.concat_ws("|", *(_as_text(f) for f in df.schema)).alias("row_text"),
        )
        for table, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, pieces)


def shape(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns per table."""
    pieces = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(table).alias("table_name"),
            "n_rows",
            F.lit(len(df.columns)).alias("n_columns"),
        )
        for table, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, pieces)


def info(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Type and non-null count of every column, one aggregation per table."""
    pieces = []
    for table, df in frames.items():
        counts = df.agg(*(F.count(c).alias(c) for c in df.columns))
        long = counts.unpivot([], df.columns, "column_name", "non_null")
        kinds = F.create_map(*(F.lit(x) for pair in df.dtypes for x in pair))
        pieces.append(
            long.select(
                F.lit(table).alias("table_name"),
                "column_name",
                kinds[F.col("column_name")].alias("data_type"),
                "non_null",
            )
        )
    return reduce(DataFrame.unionByName, pieces)


def describe(
    frames: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]], approx: bool = False
) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per numeric column of every table.

    Means are exact for integers and decimals. One pass over each table takes the moments and a
    rank sketch of all its columns side by side; these few rows are fetched and the values near a
    quartile ranked exactly. No column is gathered in one task. ``approx`` answers from the sketch.
    """
    pieces = [
        frames[table]
        .agg(*(F.struct(_moments(c).alias("m"), sketch(c, QUARTILES, approx).alias("edges")).alias(c) for c in names))
        .unpivot([], list(names), "column_name", "s")
        .select(F.lit(table).alias("table_name"), "column_name", "s.m.*", "s.edges")
        for table, names in columns.items()
    ]
    facts = reduce(DataFrame.unionByName, pieces)
    if approx:
        return _described(facts.withColumnRenamed("edges", "quantiles"))
    # One row per column.
    known = facts.collect()
    facts = facts.sparkSession.createDataFrame(known, facts.schema).drop("edges")
    edges = {(r.table_name, r.column_name): (r.n, r.edges) for r in known}
    quartiles = column_quantiles(frames, edges, QUARTILES)
    if quartiles is None:
        return _described(facts.withColumn("quantiles", F.lit(None).cast("array<double>")))
    return _described(facts.join(F.broadcast(quartiles), ["table_name", "column_name"], "left"))


def _described(facts: DataFrame) -> DataFrame:
    quartile = {p: F.get("quantiles", F.lit(i)) for i, p in enumerate(("p25", "p50", "p75"))}
    return facts.select(
        "table_name", "column_name", "n", "mean", "std", "min",
        *(q.alias(p) for p, q in quartile.items()), "max",
    )


def _moments(column: str) -> Column:
    return F.struct(
        F.count(column).alias("n"),
        mean(column).alias("mean"),
        F.stddev_samp(F.col(column).cast("double")).alias("std"),
        F.min(column).cast("double").alias("min"),
        F.max(column).cast("double").alias("max"),
    )
