"""Exact stratified sampling and splitting without gathering a class.

Every row gets a fixed pseudo-random text (md5 of its identity and a seed). Taking the *k* first
rows of a class in that order means finding the *k*-th smallest text. A histogram over the first
four hex digits (65,536 cells per class) finds the cell it lies in; only the rows of that one cell
are ranked. The pick itself is then a plain comparison with one threshold per class, so the result
is the same however the data is partitioned and survives a lost executor.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL_DIGITS = 4
SEED = 42
TEST_SHARE = 0.2
# Fixed value: row cap where a sample is asked for without one.
MAX_TRAIN_ROWS = 400_000


def draw_key(identity: Sequence[str], seed: int = SEED) -> Column:
    """Pseudo-random hex text that depends on the row only. ``identity`` must tell rows apart."""
    return F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in identity), F.lit(str(seed))))


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """Rows per class with the overall count; a class is one row here."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_rows"))
    return sizes.withColumn("all_rows", F.sum("class_rows").over(W.partitionBy()))


def pick_thresholds(df: DataFrame, label: str, draw: Column, quota: Column) -> DataFrame:
    """One row (label, ``last``) per class: the draw key of the last of its first *quota* rows.

    ``quota`` is an expression over ``class_rows`` and ``all_rows`` (and ``class_rank`` and
    ``left_over``, for quotas that hand out a remainder). A class with quota 0 has no row.
    """
    cell = F.substring(draw, 1, CELL_DIGITS)
    cells = df.groupBy(label, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    running = W.partitionBy(label).orderBy("_cell")
    quotas = class_sizes_from(cells, label).select(label, quota.cast("bigint").alias("_quota"))
    # One row per class (two classes in every model here): the cell that holds the last picked
    # row, and how many to take from it.
    edge = (
        cells.withColumn("_end", F.sum("_n").over(running))
        .join(F.broadcast(quotas), label)
        .filter((F.col("_end") >= F.col("_quota")) & (F.col("_end") - F.col("_n") < F.col("_quota")))
        .select(
            F.col(label).alias("_label"),
            F.col("_cell").alias("_edge"),
            (F.col("_quota") - F.col("_end") + F.col("_n")).alias("_take"),
        )
    )
    order = W.partitionBy(label).orderBy("_key")
    return (
        df.select(label, draw.alias("_key"), cell.alias("_cell"))
        .join(F.broadcast(edge), (F.col(label) == F.col("_label")) & (F.col("_cell") == F.col("_edge")))
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") == F.col("_take"))
        .select(label, F.col("_key").alias("last"))
    )


def with_pick(df: DataFrame, label: str, draw: Column, quota: Column, name: str) -> DataFrame:
    """Boolean ``name``: is the row among the first *quota* rows of its class?"""
    last = pick_thresholds(df, label, draw, quota).withColumnRenamed("last", "_last")
    # Again one row per class.
    return (
        df.withColumn("_draw_key", draw)
        .join(F.broadcast(last), label, "left")
        .withColumn(name, F.coalesce(F.col("_draw_key") <= F.col("_last"), F.lit(False)))
        .drop("_draw_key", "_last")
    )


def picked_by(thresholds: Mapping[int, str], label: str, draw: Column) -> Column:
    """The same test with thresholds that are already known, as a plain expression."""
    test = F.lit(False)
    for value, last in thresholds.items():
        test = test | ((F.col(label) == value) & (draw <= last))
    return test


def class_sizes_from(cells: DataFrame, label: str) -> DataFrame:
    """Class totals from the histogram, with the rank of each class for handing out remainders."""
    sizes = cells.groupBy(label).agg(F.sum("_n").alias("class_rows"))
    totals = sizes.withColumn("all_rows", F.sum("class_rows").over(W.partitionBy()))
    share = train_rows(F.col("all_rows")) * F.col("class_rows") / F.col("all_rows")
    by_remainder = W.partitionBy("all_rows").orderBy(
        (share - F.floor(share)).desc(), F.col(label)
    )
    shared = totals.withColumn("class_rank", F.row_number().over(by_remainder))
    handed = F.sum(F.floor(share)).over(W.partitionBy("all_rows"))
    return shared.withColumn("left_over", train_rows(F.col("all_rows")) - handed)


def train_rows(all_rows: Column, test_share: float = TEST_SHARE) -> Column:
    """Size of the training part: what is left after a test part rounded up."""
    return all_rows - F.ceil(all_rows * test_share)


def sample_quota(cap: int) -> Column:
    """Rows to take from a class so that at most ``cap`` are left and the ratio is kept."""
    share = F.floor(F.lit(float(cap)) * F.col("class_rows") / F.col("all_rows"))
    return F.when(F.col("all_rows") <= cap, F.col("class_rows")).otherwise(
        F.least(F.col("class_rows"), share)
    )


def train_quota() -> Column:
    """Training rows of a class: the floor of its share, and one of the rows left over for the
    classes with the largest remainders."""
    exact = train_rows(F.col("all_rows")) * F.col("class_rows") / F.col("all_rows")
    return F.floor(exact) + (F.col("class_rank") <= F.col("left_over")).cast("int")


def stratified_sample(
    df: DataFrame, label: str, draw: Column, cap: int = MAX_TRAIN_ROWS
) -> DataFrame:
    """At most ``cap`` rows with the class ratio kept; everything when there are no more."""
    picked = with_pick(df, label, draw, sample_quota(cap), "_picked")
    return picked.filter("_picked").drop("_picked")


def stratified_split(
    df: DataFrame, label: str, draw: Column, name: str = "is_train"
) -> DataFrame:
    """Mark 80 % of every class as training rows."""
    return with_pick(df, label, draw, train_quota(), name)


def union_strata(parts: Sequence[DataFrame]) -> DataFrame:
    """Put per-class samples back together."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
