"""Orderings with a fixed tie-break, top rows and leading keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_desc(df: DataFrame, measure: Column | str, *ties: str) -> DataFrame:
    """Largest first, missing measures last; ``ties`` make the order total."""
    value = F.col(measure) if isinstance(measure, str) else measure
    return df.orderBy(value.desc_nulls_last(), *ties)


def top(df: DataFrame, measure: Column | str, n: int, *ties: str) -> DataFrame:
    """The ``n`` largest rows: each partition keeps ``n``, one merge follows."""
    return order_desc(df, measure, *ties).limit(n)


def top_by_size(df: DataFrame, measure: str, n: int, final: Column, *ties: str) -> DataFrame:
    """The ``n`` rows largest in absolute value, then ordered by ``final``."""
    return top(df, F.abs(F.col(measure)), n, *ties).orderBy(final, *ties)


def leading_key(df: DataFrame, key: str, measure: str) -> DataFrame:
    """One row: the key with the largest measure (the smaller key on a tie) and that measure."""
    # max_by on (measure, reversed rank of key) would need a window; a sorted struct does not.
    best = F.min(F.struct((-F.col(measure)).alias("_m"), F.col(key).alias("_k")))
    return (
        df.filter(F.col(measure).isNotNull())
        .agg(best.alias("_b"))
        .select(F.col("_b._k").alias(key), (-F.col("_b._m")).alias(measure))
    )


def leading_per_group(df: DataFrame, group: str, key: str, measure: str) -> DataFrame:
    """The row with the largest measure in every group (the smaller key on a tie)."""
    order = W.partitionBy(group).orderBy(F.col(measure).desc(), F.col(key))
    return df.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")
