"""What the two vector searches share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id long, vector array<double>`` of rows that can take part, one for each vec_id.

    Rows with a null vec_id, a null or empty vector, or null or non-finite components take no
    part. Of rows that share a vec_id the greatest vector (as arrays are ordered) stands for all.
    """
    finite = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    rows = embeddings.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")
    )
    rows = rows.filter("vec_id is not null and size(vector) > 0").filter(finite)
    return rows.groupBy("vec_id").agg(F.max("vector").alias("vector"))


def packed(column) -> list[bytes]:
    """Vectors of an Arrow list column as bytes of doubles."""
    flat = np.asarray(column.flatten(), np.float64)
    ends = np.cumsum([len(v) for v in column])
    return [v.tobytes() for v in np.split(flat, ends[:-1])] if len(ends) else []


def stacked(values, kind=np.float64) -> np.ndarray:
    """Rows of bytes of equal length as a matrix."""
    values = list(values)
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)
