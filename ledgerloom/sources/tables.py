"""Strict readers: CSV by position, pattern blocks, guarded stores, fingerprints and file profiles."""

from __future__ import annotations

import csv
import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.files import read_text, write_text

#: Names of the raw CSV's columns, in order, and their types.
TRANSACTION = [("timestamp", "timestamp_ntz"), ("from_bank", "string"), ("from_account", "string"), ("to_bank", "string"), ("to_account", "string"), ("amount_received", "double"), ("receiving_currency", "string"), ("amount_paid", "double"), ("payment_currency", "string"), ("payment_format", "string"), ("is_laundering", "tinyint")]
STORES = {"runtime": ("transactions", "alerts", "account_day_stats", "features", "kyc", "dispositions"), "eval": ("alert_labels", "laundering_legs", "agent_split", "planting")}


def read_transactions(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """CSV with a checked header, renamed by position, cast strictly; ``row_id`` is the position in the file."""
    names = [n for n, _ in TRANSACTION]
    raw = spark.read.schema(T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").csv(path)
    if header is not None:
        check_header(spark, path, header)

    def typed(i: int, name: str, kind: str):
        c = F.col(f"_{i}")
        return (F.to_timestamp_ntz(c, F.lit("yyyy/MM/dd HH:mm")) if kind == "timestamp_ntz" else c.cast(kind)).alias(name)

    return with_position(raw).select("row_id", *[typed(i, n, k) for i, (n, k) in enumerate(TRANSACTION)])


#: Names of the accounts file's columns, in order.
ACCOUNTS = ["bank_name", "bank_id", "account_number", "entity_id", "entity_name"]


def read_accounts(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """The accounts CSV by position, all strings, with ``row_id`` and ``entity_type``: X of an entity called ``X #n``, else null."""
    if header is not None:
        check_header(spark, path, header)
    raw = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in ACCOUNTS])).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").csv(path)
    kind = F.when(F.col("entity_name").rlike(r"^(.*) #\d+$"), F.regexp_extract("entity_name", r"^(.*) #\d+$", 1))
    return with_position(raw).withColumn("entity_type", kind)


def check_header(spark: SparkSession, path: str, header: list[str]) -> None:
    """Raise unless every file under ``path`` begins with these fields."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    firsts = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("line"))
    wrong = firsts.filter(F.rtrim(F.col("line"), F.lit("\r")) != F.lit(",".join(header))).limit(1).collect()
    if wrong or not firsts.limit(1).count():
        raise ValueError(f"the header of {path} is not the expected one")


def with_position(df: DataFrame) -> DataFrame:
    """``row_id``: the row's position.  Rows are counted per partition first, so no single task sees them all."""
    marked = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    counts = sorted((r["__part"], r["n"]) for r in marked.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, at = {}, 0
    for part, n in counts:
        before[part], at = at, at + n
    offset = F.create_map(*[x for k, v in before.items() for x in (F.lit(k), F.lit(v))])[F.col("__part")] if before else F.lit(0)
    return marked.select((F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + offset).alias("row_id"), *df.columns)


_BEGIN, _END = re.compile(r"^BEGIN LAUNDERING ATTEMPT - ([A-Z-]+)(?::\s+Max (\d+)[ -].*)?$"), re.compile(r"^END LAUNDERING ATTEMPT - ([A-Z-]+).*$")


def parse_patterns(lines: list[str]) -> list[tuple]:
    """(attempt_id from 0, typology, parameter, txn_index, fields) of every payment in BEGIN/END blocks; fields may be quoted."""
    rows, attempt, open_block, index = [], -1, None, 0
    for at, line in enumerate((x.strip() for x in lines), 1):
        if not line:
            continue
        if begin := _BEGIN.match(line):
            if open_block:
                raise ValueError(f"line {at}: a block begins inside another")
            open_block, index, attempt = (begin[1], int(begin[2]) if begin[2] else None), 0, attempt + 1
        elif end := _END.match(line):
            if not open_block:
                raise ValueError(f"line {at}: a block ends that has not begun")
            if end[1] != open_block[0]:
                raise ValueError(f"line {at}: {open_block[0]} ends as {end[1]}")
            if index == 0:
                raise ValueError(f"line {at}: an empty block")
            open_block = None
        elif not open_block:
            raise ValueError(f"line {at}: a payment outside a block")
        else:
            fields = next(csv.reader([line]))
            if len(fields) != len(TRANSACTION):
                raise ValueError(f"line {at}: {len(fields)} fields")
            rows.append((attempt, *open_block, index, fields))
            index += 1
    if open_block:
        raise ValueError("the last block does not end")
    return rows


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """The pattern file as rows; the file is one sequence of blocks, so one task parses it."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for text in batch["value"]:
                found = parse_patterns(text.splitlines())
                yield pd.DataFrame([(a, t, p, i, f) for a, t, p, i, f in found], columns=["attempt_id", "typology", "typology_param", "txn_index", "fields"]).astype({"typology_param": "Int32"})

    rows = spark.read.text(path, wholetext=True).mapInPandas(run, "attempt_id int, typology string, typology_param int, txn_index int, fields array<string>")
    return rows.select("attempt_id", "typology", "typology_param", "txn_index", *[(F.to_timestamp_ntz(F.col("fields")[i], F.lit("yyyy/MM/dd HH:mm")) if k == "timestamp_ntz" else F.col("fields")[i].cast(k)).alias(n) for i, (n, k) in enumerate(TRANSACTION)])


class Catalog:
    """Stores under one folder; only listed names can be opened, and evaluation stores only where it is allowed."""

    def __init__(self, spark: SparkSession, root: str, stores: tuple[str, ...] = ("runtime",)):
        self.spark, self.root, self.stores = spark, root.rstrip("/"), stores

    def path(self, store: str, name: str) -> str:
        if store not in self.stores or name not in STORES.get(store, ()):
            raise PermissionError(f"{store}/{name} is not open here")
        return f"{self.root}/{store}/{name}"

    def scan(self, store: str, name: str, columns: list[str] | None = None) -> DataFrame:
        df = self.spark.read.parquet(self.path(store, name))
        return df.select(*columns) if columns else df

    def describe(self, store: str, name: str) -> tuple[T.StructType, int]:
        """Schema and number of rows, from the files' metadata: no column is read."""
        df = self.scan(store, name)
        return df.schema, df.count()

    def write(self, df: DataFrame, store: str, name: str, partition_by: str | None = None, sort_by: list[str] | None = None) -> None:
        """Overwrite a store; ``sort_by`` orders the rows of every file, which keeps equal input in equal files."""
        if sort_by:
            df = df.sortWithinPartitions(*([partition_by] if partition_by else []), *sort_by)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(store, name))


def relaxed_union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all tables: columns by name, missing ones null, and columns of different types in the type that holds both."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def verify_file(spark: SparkSession, path: str, size: int, sha256: str, rows: int | None = None) -> None:
    """Raise unless a file has this size and hash and, for Parquet, this many rows."""
    found = file_profiles(spark, path).select("bytes", "sha256").collect()
    if [(r["bytes"], r["sha256"]) for r in found] != [(size, sha256)]:
        raise ValueError(f"{path} is not the registered file: {[tuple(r) for r in found]}")
    if rows is not None and spark.read.parquet(path).count() != rows:
        raise ValueError(f"{path} does not have {rows} rows")


def cache_key(**parts) -> str:
    """Semantic key of a stage: its inputs and parameters."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def mark_current(spark: SparkSession, folder: str, key: str, **facts) -> None:
    """Write a stage's manifest once its tables are complete."""
    write_text(spark, f"{folder.rstrip('/')}/manifest.json", json.dumps({"key": key, "complete": True, **facts}, sort_keys=True))


def is_current(spark: SparkSession, folder: str, key: str) -> bool:
    """Whether a folder's manifest names this key and is complete; a stale one raises."""
    text = read_text(spark, f"{folder.rstrip('/')}/manifest.json")
    if text is None:
        return False
    found = json.loads(text)
    if not found.get("complete"):
        return False
    if found.get("key") != key:
        raise ValueError(f"{folder} was made from other inputs")
    return True


def file_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Size, SHA-256, line ends, UTF-8 validity and byte order mark of files of any size, read line by line.

    A file's lines go in order to one task, as its hash is one sequence; the task holds a batch of them at a time.
    """
    import pyarrow as pa

    sizes = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes"))
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))
    ordered = lines.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "path").repartition("path").sortWithinPartitions("path", "block", "at").select("path", "bytes", "line")

    def run(batches: Iterator) -> Iterator:
        state: dict = {}

        def done(s: dict):
            bom = s["size"] - s["seen"] >= 2  # Spark's reader leaves out a byte order mark
            ends = s["size"] == s["seen"] + 3 * bom  # whether the last line has its line end too
            digest = s["hashes"][bom]
            if ends:
                digest.update(b"\n")
            names = ["path", "bytes", "sha256", "newlines", "crlf", "utf8", "bom"]
            values = [s["path"], s["size"], digest.hexdigest(), s["lines"] - (not ends), s["crlf"] - (s["cr"] and not ends), s["valid"], bom]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names)

        for batch in batches:
            for name, size, line in zip(*(c.to_pylist() for c in batch.columns)):
                if name != state.get("path"):
                    if state:
                        yield done(state)
                    state = {"path": name, "size": size, "seen": 0, "lines": 0, "crlf": 0, "cr": False, "valid": True, "hashes": (hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf"))}
                else:
                    for digest in state["hashes"]:
                        digest.update(b"\n")
                for digest in state["hashes"]:
                    digest.update(line)
                state["seen"] += len(line) + 1
                state["lines"] += 1
                state["cr"] = line.endswith(b"\r")
                state["crlf"] += state["cr"]
                if state["valid"]:
                    try:
                        line.decode("utf-8")
                    except UnicodeDecodeError:
                        state["valid"] = False
        if state:
            yield done(state)

    found = ordered.mapInArrow(run, "path string, bytes long, sha256 string, newlines long, crlf long, utf8 boolean, bom boolean")
    empty = sizes.filter("bytes = 0").select("path", "bytes", F.lit(hashlib.sha256().hexdigest()).alias("sha256"), F.lit(0).cast("long").alias("newlines"), F.lit(0).cast("long").alias("crlf"), F.lit(True).alias("utf8"), F.lit(False).alias("bom"))
    return found.unionByName(empty)


def csv_profile(spark: SparkSession, path: str) -> DataFrame:
    """Distribution of field counts, quoted fields as one, with the longest line and the lines whose quotes do not close."""
    lines = spark.read.text(path)
    plain = F.regexp_replace("value", r'"(?:[^"]|"")*"', "q")
    return lines.groupBy(F.size(F.split(plain, ",")).alias("n_fields")).agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("value")).alias("longest"), F.count(F.when(F.contains(plain, F.lit('"')), 1)).alias("n_open_quotes"))


def unique_names(header: list[str]) -> list[str]:
    """Names of a header's columns; a repeated one gets the number of its occurrence."""
    seen: dict[str, int] = {}
    out = []
    for name in header:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def block_census(spark: SparkSession, path: str) -> DataFrame:
    """``kind, typology, parameter, n``: BEGIN and END lines by what they name, payments by their number of fields, and others."""
    line = F.trim(F.rtrim(F.col("value"), F.lit("\r")))
    named = F.regexp_extract(line, r"^(?:BEGIN|END) LAUNDERING ATTEMPT - ([A-Z-]+)", 1)
    kind = F.when(line == "", "blank").when(line.startswith("BEGIN LAUNDERING ATTEMPT - "), "begin").when(line.startswith("END LAUNDERING ATTEMPT - "), "end").when(line.rlike(r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2},"), "payment").otherwise("other")
    rows = spark.read.text(path).select(kind.alias("kind"), F.nullif(named, F.lit("")).alias("typology"), F.nullif(F.regexp_extract(line, r":\s+Max (\d+)", 1), F.lit("")).cast("int").alias("parameter"))
    return rows.groupBy("kind", "typology", "parameter").agg(F.count(F.lit(1)).alias("n"))


def line_templates(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their digits masked, by frequency."""
    return spark.read.text(path).groupBy(F.regexp_replace("value", r"\d+", "#").alias("template")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "template")


def head_tail(spark: SparkSession, path: str, n_head: int = 5, n_tail: int = 5) -> DataFrame:
    """``part, position, line``: the first lines of a file and its last that are not empty, in order.

    Each end is a top-k over positions, so a task sends at most ``n_head`` or ``n_tail`` lines.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("position"), F.rtrim(F.col("value"), F.lit("\r")).alias("line"))
    head = lines.orderBy("position").limit(n_head).select(F.lit("head").alias("part"), "position", "line")
    tail = lines.filter("line <> ''").orderBy(F.col("position").desc()).limit(n_tail).select(F.lit("tail").alias("part"), "position", "line")
    return head.unionByName(tail).orderBy("part", "position")
