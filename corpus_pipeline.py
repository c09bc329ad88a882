"""A training-data pipeline over ``documents``: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import mixing, neardup, packing, pii, quality
from ledgerlens.llm.common import importable, read_table, written

STAGES = [
    ("quality classifier", quality.keep_good),
    ("near duplicates", neardup.one_of_each),
    ("surrogates", pii.surrogates_in),
    ("mixing", mixing.mixed),
    ("packing", packing.packed),
]

#: Classifier verdicts, surrogates and the balanced draw are beyond SQL; tests/llm compares every
#: stage with a plain version instead.
ORACLE_SQL = None


@importable
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; every other stage is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
