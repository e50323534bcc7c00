"""Cutting a plan's lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to ``spark.checkpoint.dir``; only local mode may do without the setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="ledgerloom-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from Parquet files in the shared folder, for plans that read some columns of them many times."""
    spark = df.sparkSession
    use_shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written once, for plans that read them many times."""
    use_shared_folder(df.sparkSession)
    return df.checkpoint()
