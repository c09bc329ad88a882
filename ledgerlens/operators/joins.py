"""Equi-joins of facts with lookups, mark joins and the report-history join.

Sides are never hinted here: Spark broadcasts a side only when its measured size is below
``spark.sql.autoBroadcastJoinThreshold``, and splits skewed partitions of a sort-merge join at run
time otherwise. What can be aggregated per key before a join is, so a hot key reaches the join as
a single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup(
    facts: DataFrame, table: DataFrame, key: str, columns: Sequence[str], how: str = "left"
) -> DataFrame:
    """Add ``columns`` of ``table`` (unique by ``key``) to ``facts``."""
    return facts.join(table.select(key, *columns), key, how)


def mark_exists(
    df: DataFrame, key: str, members: DataFrame, name: str, member_key: str | None = None
) -> DataFrame:
    """Boolean ``name``: does the key of the row occur among ``members``?

    Members are reduced to distinct keys first, so the join adds no rows and a member that occurs
    a million times costs one.
    """
    keys = members.select(F.col(member_key or key).alias(key)).filter(
        F.col(key).isNotNull()
    ).distinct()
    marked = df.join(keys.withColumn("_hit", F.lit(True)), key, "left")
    return marked.withColumn(name, F.col("_hit").isNotNull()).drop("_hit")


def minus_baseline(df: DataFrame, column: str, baseline: DataFrame, name: str) -> DataFrame:
    """``column`` minus one overall value, taken from a one-row frame as a scalar subquery."""
    return df.withColumn(name, F.col(column) - baseline.scalar())


def report_history(
    days: DataFrame, reports: DataFrame, key: str, day: str, report_day: str,
    count: str | None = None,
) -> DataFrame:
    """Add to every ``(key, day)`` row how many reports there are: all, and at or before the day.

    ``days`` is unique by ``(key, day)``; other columns pass through. ``count`` names a column with
    the reports a row of ``reports`` stands for; without it, each stands for one. A join of every event with
    every report of its customer would emit all pairs of a group; counting needs none of them.
    Reports are counted per day (or instant), both sides are laid on one time line, and a running sum
    gives the reports so far. It runs within the month; what earlier months hold comes from one row
    per key and month. So a task holds one month of a key, also where days are timestamps and a
    busy key has a row for every instant.
    """
    events = days.withColumns({"_filed": F.lit(0).cast("bigint"), "_event": F.lit(True)})
    filed = (
        reports.filter(F.col(key).isNotNull())
        .groupBy(key, F.col(report_day).alias(day))
        .agg((F.sum(count) if count else F.count(F.lit(1))).cast("bigint").alias("_filed"))
        .withColumn("_event", F.lit(False))
    )
    line = events.unionByName(filed, allowMissingColumns=True)
    # Reports without a day are in a month of their own, before all others, and prior to nothing.
    line = line.withColumn("_month", F.date_trunc("month", F.col(day)))
    dated = F.when(F.col(day).isNotNull(), F.col("_filed")).otherwise(F.lit(0))
    months = line.groupBy(F.col(key).alias("_key"), F.col("_month").alias("_of")).agg(
        F.sum("_filed").alias("_all"), F.sum(dated).alias("_dated")
    )
    whole = W.partitionBy("_key")
    earlier = whole.orderBy(F.col("_of").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    months = months.select(
        "_key",
        "_of",
        F.sum("_all").over(whole).alias("n_reports"),
        F.coalesce(F.sum("_dated").over(earlier), F.lit(0)).alias("_before"),
    )
    so_far = W.partitionBy(key, "_month").orderBy(F.col(day)).rangeBetween(
        W.unboundedPreceding, W.currentRow
    )
    counted = line.withColumn("_within", F.sum(dated).over(so_far)).filter("_event")
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_month").eqNullSafe(F.col("_of"))
    return (
        counted.join(months, same)
        .withColumn("n_prior_reports", F.col("_before") + F.col("_within"))
        .drop("_filed", "_event", "_month", "_within", "_key", "_of", "_before")
    )


def pairs_with_prior() -> Column:
    """Rows of the event-report left join whose report came first, for one event."""
    return F.col("n_prior_reports")


def pairs_without_prior() -> Column:
    """The other rows of that join; an event without any report still has one row."""
    return F.greatest(F.col("n_reports"), F.lit(1)) - F.col("n_prior_reports")
