"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerlens.sources.scratch import written

__all__ = ["batch_bytes", "importable", "read_table", "slices", "text_words", "unused", "with_score", "written"]


def importable(query: Callable) -> Callable:
    """Let Python workers of a session that was started elsewhere import this package."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        home = str(Path(__file__).resolve().parents[2])
        spark.sparkContext.environment.setdefault("PYTHONPATH", home)
        return query(spark, sf_dir)

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_score(df: DataFrame, name: str) -> StructType:
    """The schema of ``df`` and a column of doubles."""
    return StructType([*df.schema.fields, StructField(name, DoubleType())])


def unused(df: DataFrame, name: str) -> str:
    """``name``, or that name with underscores if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_words(text: str | None) -> list[bytes]:
    """Words of a whole text: A-Z lower-cased, cut at blanks and the controls 09 to 0D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(lengths: list[int], most: int) -> Iterator[slice]:
    """Consecutive slices whose lengths add up to ``most`` at most, or hold one item."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def batch_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow text column, null as empty."""
    return [b"" if v is None else v.encode("utf-8", "surrogatepass") for v in column.to_pylist()]
