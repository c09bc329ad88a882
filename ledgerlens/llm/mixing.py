"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source is wanted ``target / source size`` times. The whole part is certain;
the fraction is an inclusion probability. Probabilities move along the null space of two
constraints, tokens and documents, three units at a time, until they are 0 or 1, so both totals
hold at every step. Sources are cut into blocks for this; a block leaves two undecided units at
most, which meet in blocks of the next level until one block a source is left. What it leaves is
the landing: the rounding of two units that misses the source's tokens least. What the roundings of
a source miss in all is then made up by turning decided units of that source.
"""

from __future__ import annotations

import itertools
import random
import zlib
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import read_table, unused, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
"""Tokens of the mix as a multiple of all tokens."""
MOST = 2.0
"""How often a source may be repeated."""
BLOCK = 4_000
"""Units that one task decides together."""
SEED = 11
RANGES = 65_536
"""Ranges of the draw among which units of one source and size are counted."""


def words(text="text") -> F.Column:
    """Number of words of a whole text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast(
        "long"
    )


def targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """``source, source_size, documents, target`` for each source; one small row each.

    Sources in code point order, null last, get the weights in turn. Tokens are shared by weight;
    a target stops at ``most`` times its source, and what is over goes to the others by weight.
    That is a level t with targets ``min(most * size, t * weight)``: sources are capped in the
    order of size / weight, as long as sharing the rest evenly would still exceed their cap.
    """
    total = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("documents")
    )
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    weighted = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    before = Window.orderBy(
        F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.sum("source_size").over(every) * F.lit(float(share))
    zero = F.lit(0)
    rest = wanted - F.coalesce(F.sum("cap").over(before), zero)
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)
    capped = weighted.withColumns(
        {"wanted": wanted, "capped": rest * F.col("weight") >= F.col("cap") * open_weight}
    )
    over = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    left = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    level = (F.col("wanted") - over) / left
    return capped.select(
        "source",
        "source_size",
        "documents",
        F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"),
    )


def flight(chances: list[float], sizes: list[int], rng: random.Random) -> list[float]:
    """Move chances to 0 or 1 keeping their sum and their sum by size; two stay open at most."""
    p = list(chances)
    tiny = 1e-9
    waiting = iter([i for i, x in enumerate(p) if tiny < x < 1 - tiny])
    active: list[int] = []
    while True:
        while len(active) < 3 and (i := next(waiting, None)) is not None:
            active.append(i)
        if len(active) < 3:
            return p
        a, b, c = active
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if not any(u):
            u = (1, -1, 0)
        # As far as the chances allow, forward and backward.
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(active, u) if x)
        down = min(p[i] / x if x > 0 else -(1 - p[i]) / x for i, x in zip(active, u) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(active, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * x))
            if p[i] <= tiny or p[i] >= 1 - tiny:
                p[i] = round(p[i])
        still = [i for i in active if 0 < p[i] < 1]
        if len(still) == 3:  # rounding of very unequal sizes: settle the nearest by hand
            near = min(still, key=lambda i: min(p[i], 1 - p[i]))
            p[near] = round(p[near])
            still.remove(near)
        active = still


def landing(start: list[float], chances: list[float], sizes: list[int]) -> list[float]:
    """Round the open chances so that the total size is missed least, then the count.

    A single very long unit may stay open to the end. What its rounding misses is made up by units
    that were drawn before in this block, as long as turning one brings the total closer.
    """
    open_units = [i for i, x in enumerate(chances) if 0 < x < 1]
    p, size = np.array(chances, float), np.array(sizes, float)
    wanted = float((np.array(start) * size).sum())
    if open_units:
        rest = wanted - float((p * size).sum()) + sum(p[i] * size[i] for i in open_units)
        count = sum(p[i] for i in open_units)
        p[open_units] = min(
            itertools.product((0.0, 1.0), repeat=len(open_units)),
            key=lambda pick: (
                abs(sum(x * size[i] for x, i in zip(pick, open_units)) - rest),
                abs(sum(pick) - count),
                pick,
            ),
        )
    free = np.array([0 < x < 1 for x in start], bool)
    while True:  # ends, as every turn brings the total closer
        miss = float((p * size).sum()) - wanted
        after = np.where(free, np.abs(miss + np.where(p > 0.5, -size, size)), np.inf)
        if not len(after) or after.min() >= abs(miss):
            break
        at = int(after.argmin())
        p[at] = 1 - p[at]
    return p.tolist()


ROW = (
    "row long, doc_id long, text_key long, number long, size long, source string,"
    " source_size long, target double, chance double"
)
SAME = ("doc_id", "source", "size", "text_key")
"""What equal rows have in common."""
DRAWN = ("doc_id", "size", "text_key", "number")
"""What a draw depends on, beside the source and the seed."""


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``number``: 0, 1, 2 ... within rows that are equal but for ``row``.

    Rows without an equal are all number 0. The others are numbered within the partition they
    were written by, and go on where earlier partitions end, so a row that is repeated without end
    meets in no task. Which of equal rows gets which number changes nothing.
    """
    repeated = rows.groupBy(*SAME).count().filter("count > 1").drop("count")
    repeated = repeated.select(*(F.col(c).alias(f"of_{c}") for c in SAME), F.lit(True).alias("repeated"))
    on = reduce(and_, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in SAME))
    marked = rows.join(written(repeated, "repeated"), on, "left").select(*rows.columns, "repeated")
    single = marked.filter("repeated is null").withColumn("number", F.lit(0).cast("long"))
    part = F.shiftright("row", 33)
    many = written(marked.filter("repeated").withColumn("part", part), "equal-rows")
    own = Window.partitionBy(*SAME, "part").orderBy("row")
    many = many.withColumn("number", F.row_number().over(own) - 1)
    parts = many.groupBy(*SAME, "part").agg(F.count("*").alias("n"))
    running = Window.partitionBy(*SAME).orderBy("part")
    parts = parts.withColumn("before", F.sum("n").over(running) - F.col("n")).drop("n")
    keys = (*SAME, "part")
    parts = parts.select(*(F.col(c).alias(f"of_{c}") for c in keys), "before")
    on = reduce(and_, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys))
    number = (F.col("number") + F.col("before")).cast("long").alias("number")
    many = many.join(parts, on).select(*rows.columns, number)
    return single.select(*many.columns).unionByName(many)


def _decide(seed: int, level: int, last: bool):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", *DRAWN]).reset_index(drop=True)
        rng = random.Random(zlib.crc32(repr((seed, level, *map(str, key))).encode()))
        sizes = group["size"].tolist()
        start = group["chance"].tolist()
        chances = flight(start, sizes, rng)
        group["chance"] = landing(start, chances, sizes) if last else chances
        return group[[c.split()[0] for c in ROW.split(", ")]]

    return run


def _turns(cells: pd.DataFrame) -> pd.DataFrame:
    """Units to turn of each size of a source, largest first, then one more if that is closer."""
    cells = cells.sort_values("size", ascending=False).reset_index(drop=True)
    rest, take = abs(float(cells["miss"].iloc[0])), []
    for size, n in zip(cells["size"].tolist(), cells["n"].tolist(), strict=True):
        take.append(min(n, int(rest // size)))
        rest -= take[-1] * size
    cells["take"] = take
    after = np.where(cells["take"] < cells["n"], np.abs(rest - cells["size"]), np.inf)
    if after.min() < rest:
        cells.loc[int(after.argmin()), "take"] += 1
    return cells.loc[cells["take"] > 0, ["of", "size", "n", "take"]]


def settled(done: DataFrame, seed: int) -> DataFrame:
    """``done`` with decided units turned until each source is as near its target as they allow.

    A source that took too much gives drawn units back, one that took too little draws more;
    certain units stay. Counts by source and size say how many of each size are turned, counts by
    range of the draw which ones, so no more than the units of one range are ranked together.
    """
    of = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = done.select(
        "row",
        of.alias("of"),
        "size",
        "target",
        "chance",
        F.floor(wanted).alias("base"),
        (wanted - F.floor(wanted)).alias("start"),
        F.pmod(F.xxhash64(*DRAWN, F.lit(seed)), F.lit(2**62)).alias("draw"),
        *(F.col(c) for c in DRAWN if c != "size"),
    )
    taken = F.sum(F.col("size") * (F.col("base") + F.col("chance")))
    misses = units.groupBy("of").agg((taken - F.first("target")).alias("miss"))
    misses = written(misses.filter("abs(miss) > 0.5"), "misses")
    # Turning a unit of twice the miss or more brings nothing closer.
    free = units.filter("start > 0 and start < 1 and size > 0").join(misses, "of").filter(
        F.col("size") < 2 * F.abs("miss")
    ).filter(F.col("chance") == F.when(F.col("miss") > 0, 1.0).otherwise(0.0))
    free = written(free.select("row", "of", *DRAWN, "draw", "miss"), "free")
    cells = free.groupBy("of", "size").agg(F.count("*").alias("n"), F.first("miss").alias("miss"))
    turns = written(
        cells.groupBy("of").applyInPandas(_turns, "of string, size long, n long, take long"), "turns"
    )
    within = F.floor(F.col("draw") / (2**62 // RANGES)).alias("range")
    some = free.join(turns.filter("take < n").drop("n"), ["of", "size"]).select(
        "row", "of", *DRAWN, "draw", "take", within
    )
    ranges = some.groupBy("of", "size", "range").agg(F.count("*").alias("n"))
    running = Window.partitionBy("of", "size").orderBy("range")
    ranges = ranges.withColumn("before", F.sum("n").over(running) - F.col("n"))
    some = some.join(ranges.drop("n"), ["of", "size", "range"]).filter("before < take")
    order = Window.partitionBy("of", "size", "range").orderBy("draw", *DRAWN)
    some = some.withColumn("turn", F.row_number().over(order) + F.col("before"))
    whole = free.join(turns.filter("take = n").select("of", "size"), ["of", "size"])
    turned = whole.select("row").union(some.filter("turn <= take").select("row"))
    turned = written(turned.withColumn("turned", F.lit(True)), "turned")
    other = F.when(F.col("turned"), 1 - F.col("chance")).otherwise(F.col("chance"))
    return done.join(turned, "row", "left").withColumn("chance", other).drop("turned")


def mix(rows: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED) -> DataFrame:
    """``row, doc_id, size, source, source_size, target, copies`` for ``rows (row, doc_id, source,
    size, text_key)``, one row each.

    ``row`` tells rows apart and must be fixed (written). ``copies`` is 0, 1 or more and never
    above ``most``. Documents without words count as documents only. A draw depends on doc_id,
    size, source, ``text_key`` (a hash of the text, or 0 where equal rows need not be told apart),
    a running number within rows that are equal in all of these, and the seed. So reruns over the
    same rows agree, in whatever order, files or partitions they come.
    """
    share_of = written(targets(rows, weights, share, most), "targets")
    rows = numbered(rows)
    wanted = share_of.withColumn(
        "wanted",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0),
    ).withColumnRenamed("source", "of")
    rows = rows.join(wanted, rows["source"].eqNullSafe(wanted["of"])).drop("of")
    rows = rows.withColumns(
        {
            "base": F.floor("wanted"),
            "draw": F.xxhash64(*DRAWN, F.lit(seed)),
            "blocks": F.ceil(F.col("documents") / BLOCK),
        }
    )
    rows = rows.withColumns(
        {
            "chance": F.col("wanted") - F.col("base"),
            "block": F.pmod(F.col("draw"), F.col("blocks")),
        }
    )
    blocks = share_of.agg(F.max(F.ceil(F.col("documents") / BLOCK))).head()[0] or 1
    level, done = 0, None
    while True:
        last = blocks <= 1
        found = written(
            rows.groupBy("source", "block").applyInPandas(_decide(seed, level, last), ROW), "flight"
        )
        fixed = found if last else found.filter("chance = 0 or chance = 1")
        done = fixed if done is None else done.union(fixed)
        if last:
            break
        # A block leaves two units at most, so this many blocks make one block of the next level.
        level, blocks = level + 1, -(-blocks // (BLOCK // 2))
        rows = found.filter("chance > 0 and chance < 1").withColumn(
            "draw", F.xxhash64(*DRAWN, F.lit(seed + level))
        )
        rows = rows.withColumn("block", F.pmod(F.col("draw"), F.lit(blocks)))
    base = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(0)
    done = settled(done, seed)
    return done.withColumn("copies", (base + F.col("chance")).cast("long")).drop("chance")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long"),
        "source",
        words().alias("size"),
        F.lit(0).cast("long").alias("text_key"),
    )
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "sizes")
    return mix(rows).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, columns as they came.

    Documents without words are kept or left by the same draw.
    """
    row, copies, copy = (unused(docs, c) for c in ("mix_row", "mix_copies", "mix_copy"))
    kept = written(docs.withColumn(row, F.monotonically_increasing_id()), "kept")
    rows = kept.select(
        F.col(row).alias("row"),
        F.col("doc_id").cast("long"),
        "source",
        words().alias("size"),
        F.xxhash64("text").alias("text_key"),
    )
    picked = mix(written(rows, "sizes")).filter("copies > 0").select(
        F.col("row").alias(row), F.col("copies").cast("int").alias(copies)
    )
    again = kept.join(picked, row).withColumn(
        copy, F.explode(F.sequence(F.lit(1), F.col(copies)))
    )
    return again.select(*docs.columns)
