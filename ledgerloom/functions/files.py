"""Small text files where Spark's own file systems reach: local folders, a cluster's, or an object store."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a UTF-8 file, with line ends as they are; folders are made, an older file is replaced."""
    place, system = _at(spark, path)
    out = system.create(place, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a UTF-8 file; None if there is no such file."""
    place, system = _at(spark, path)
    if not system.exists(place):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""
