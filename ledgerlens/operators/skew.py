"""Joins that stay balanced when a few keys hold much of the data.

A join whose inputs are both plain shuffles is left to adaptive execution, which splits oversized
partitions while it runs. It cannot do so when one input has been aggregated by the join key, as
the two then share a stage. These joins spread the hot keys themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of one key that a task may get. It grows only when more than MOST_KEYS keys would be hot.
ROWS_PER_TASK = 1_000_000
MOST_KEYS = 10_000
# Counters of the frequency sketch for each key it may report.
COUNTERS = 16


def hot_keys(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> dict[object, int]:
    """Number of tasks for every key with more than ``rows_per_task`` rows; null is a key too.

    One count, then one pass over the key column with a sketch whose size follows from the number
    of keys that can be hot. At most ``MOST_KEYS`` keys come back, whatever the data.
    """
    rows = df.count()
    target = max(rows_per_task, -(-rows // MOST_KEYS))
    most = max(1, min(MOST_KEYS, rows // target))
    frequent = F.expr(f"approx_top_k(`{key}`, {most}, {COUNTERS * most})")
    found = df.agg(frequent.alias("top"), F.count_if(F.col(key).isNull()).alias("none")).first()
    tasks = {t["item"]: -(-t["count"] // target) for t in found["top"] or [] if t["count"] > target}
    if found["none"] > target:
        tasks[None] = -(-found["none"] // target)
    return tasks


def salted_lookup(
    facts: DataFrame, table: DataFrame, key: str, columns: Sequence[str], how: str = "left",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``columns`` of ``table`` (unique by ``key``) with hot keys spread over many tasks.

    The hot keys are found first, once, and both sides see the same list of constants. Rows with a
    hot key get a salt from their own content, so a repeated task gives the same rows; the one
    table row of that key is repeated per salt. Rows without a key match nothing and are spread
    as well. Other keys join as usual.
    """
    hot = hot_keys(facts, key, rows_per_task)
    if not hot:
        return facts.join(table.select(key, *columns), key, how)
    tasks = F.when(F.col(key).isNull(), hot.pop(None, 1))
    if hot:
        pairs = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])
        kind = facts.schema[key].dataType
        pairs = pairs.cast(T.MapType(kind, T.LongType()))
        tasks = tasks.otherwise(F.element_at(pairs, F.col(key)))
    tasks = F.coalesce(tasks, F.lit(1)).cast("long")
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), tasks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1))
    right = table.select(key, *columns).withColumn("_salt", every)
    return left.join(right, [key, "_salt"], how).drop("_salt")
