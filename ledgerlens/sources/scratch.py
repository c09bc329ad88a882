"""Where intermediate tables may be written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, visible to every executor.

    Where it is not set, a folder below ``spark.sql.warehouse.dir``, which the executors share as
    well, takes its place for the session. A folder of one machine is refused on a cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    own_disk = not warehouse or warehouse.startswith("file:") or ":" not in warehouse
    if not warehouse or own_disk and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = f"{warehouse.rstrip('/')}/_scratch-{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/ledgerlens/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Delete everything this application has written to the shared folder.

    Frames that read from there cannot be used afterwards, so call it at the end of a job.
    """
    home = f"{shared_folder(spark)}/ledgerlens/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows as a table in the shared folder.

    Frames that are read many times get a short plan this way, and a lost executor costs a read,
    not the whole computation.
    """
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
