"""Shared helpers: null-safe text input, Arrow batch mapping and the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents handled at once inside a Python worker; bounds its memory, not the result.
SLICE_ROWS = 256

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only in local mode.

    A session on a cluster without that setting is refused rather than given a machine-local folder.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        found = _OWN_DIRS.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="ledgerloom-"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    # the schema is known, so no job reads footers for it
    return spark.read.parquet(path) if partition_by else spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in the shared folder, deleted at its end; what outlives it is written by ``materialise``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/scratch-{name}-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame, small: bool = False) -> DataFrame:
        """``small``: the rows are a fraction of those they come from, and need as few files."""
        self.n += 1
        if small:
            df = df.coalesce(max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8))
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def __exit__(self, *_) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """A text column as a string, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_of(column: str = "doc_id") -> Column:
    return F.col(column).cast("long")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``; empty batches are dropped."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield f(part)

    return df.mapInArrow(run, schema)


def summed(df: DataFrame, count: Callable[[pa.RecordBatch], np.ndarray], size: int, slice_size: int = 4096) -> np.ndarray:
    """The sum over ``df`` of the arrays of ``size`` counts that ``count`` makes of a batch.

    A task adds up its own batches and sends the slices it has used; each slice is summed apart, so the driver gets
    ``size`` numbers at most, however many rows there are.
    """
    padded = -(-size // slice_size) * slice_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(padded, dtype=np.int64)
        for part in slices(batches):
            total[:size] += count(part)
        parts = total.reshape(-1, slice_size)
        used = np.flatnonzero(parts.any(axis=1))
        yield batch_of(slice=pa.array(used, pa.int32()), counts=pa.array([parts[i].tobytes() for i in used], pa.binary()))

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(slice_size, dtype=np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), dtype=np.int64)
        return pa.table({"slice": table.column("slice").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    found = np.zeros(padded, dtype=np.int64).reshape(-1, slice_size)
    for row in df.mapInArrow(run, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():
        found[row["slice"]] = np.frombuffer(row["counts"], dtype=np.int64)
    return found.reshape(-1)[:size]


def in_one_task(df: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``f`` of all rows of a bounded table, in one task that can be run again if its executor is lost.

    For the fits: their samples are bounded by a documented parameter, and the driver holds none of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from f(pa.Table.from_batches(held)).to_batches()

    return df.repartition(1).mapInArrow(run, schema)


def batch_of(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def utf8_buffer(texts: pa.Array) -> tuple[memoryview, list[int]]:
    """One buffer with the UTF-8 of every text, and the offsets of the texts in it."""
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        texts, width = texts.cast(pa.string()), np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=width, count=len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    return memoryview(data if data is not None else b""), offsets.tolist()
