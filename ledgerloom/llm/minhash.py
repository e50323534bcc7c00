"""Document fingerprints: one-permutation MinHash with optimal densification, in DataFrame functions only.

Words are the runs between white space of the lower-cased text; a shingle is the hash of five consecutive words (of
all words, if there are fewer).  Each shingle falls into one of ``BINS`` bins once and each bin keeps its smallest
value.  An empty bin takes the value of the occupied bin that a universal hash of the two bins ranks first, a uniform
choice that two similar documents make alike.  The fingerprint packs the low ``BITS`` bits of the bins as hex.
Likeness is the share of equal bins, corrected for the 2**-BITS of them that agree by chance, and at least 0.

The next document by id is found without a global sort: documents are dealt into id ranges, each range also gets a
copy of the first document of the next one, and ``lead`` runs inside the ranges.  Texts are exchanged once.

Edge cases: null texts are empty; very long texts are hashed whole; of equal values in a bin one counts; a text without words has an empty fingerprint string, which is like another empty
one (1.0) and unlike any other (0.0); null ids sort first; equal ids are ordered by the hash of their texts; a single
document is its own next one; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_of, text_of

SHINGLE, BINS, BITS = 5, 128, 8
#: Rows of an id range; small enough for a window to buffer in memory.
RANGE_ROWS = 1000
#: Ranges that are put in order by one task.
RANGE_BLOCK = 1000
#: Id ranges found by percentiles; beyond that each is cut into equal widths.
MOST_PERCENTILES = 8192
#: First rows of ranges are broadcast up to this many (16 bytes each), else joined by exchange.
BROADCAST_RANGES = 200_000

_VALUE_BITS = 56


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def signature(text: Column) -> Column:
    """Array of BINS longs, ``bin << BITS | code`` in bin order; empty for a text without words."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), _of_word_hashes)))


def _of_word_hashes(hashes: Column) -> Column:
    def at(i: Column) -> Column:
        return F.xxhash64(*[F.get(hashes, i + k) for k in range(SHINGLE)])

    keep = F.lit((1 << _VALUE_BITS) - 1)
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.size(hashes) - SHINGLE, F.lit(0))), at)
    binned = F.transform(shingles, lambda h: F.shiftleft(F.shiftrightunsigned(h, 64 - 7), _VALUE_BITS).bitwiseOR(h.bitwiseAND(keep)))
    return let(F.sort_array(binned), _of_sorted)


def _of_sorted(ordered: Column) -> Column:
    def bin_of(x: Column) -> Column:
        return F.shiftright(x, _VALUE_BITS)

    firsts = F.filter(ordered, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(ordered, i - 1))))
    coded = F.transform(firsts, lambda x: F.shiftleft(bin_of(x), BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1))))
    return let(coded, lambda c: F.when(F.size(c) == BINS, c).otherwise(_densified(c)))


def _densified(coded: Column) -> Column:
    low = F.lit((1 << BITS) - 1).cast("long")
    empty = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), F.transform(coded, lambda x: F.shiftright(x, BITS)))

    def donated(at: Column) -> Column:
        ranked = F.transform(coded, lambda x: F.xxhash64(at, F.shiftright(x, BITS)).bitwiseAND(F.lit(-(1 << BITS)).cast("long")).bitwiseOR(x.bitwiseAND(low)))
        return F.shiftleft(at, BITS).bitwiseOR(F.array_min(ranked).bitwiseAND(low))

    return F.sort_array(F.concat(coded, F.transform(empty, donated)))


def packed(bins: Column) -> Column:
    """The fingerprint string: BITS bits of each bin, as lowercase hex."""
    return F.lower(F.array_join(F.transform(bins, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))), BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    chance = 2.0**-BITS
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda t: t)) / F.lit(float(BINS))
    known = F.greatest(F.lit(0.0), (same - chance) / (1.0 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(known)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, bins``: the operator on its own, one row per input row."""
    return docs.select(id_of(id_col).alias("doc_id"), signature(text_of(text_col)).alias("bins")).select("doc_id", packed("bins").alias("fingerprint"), "bins")


def id_ranges(docs: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[Column, int]:
    """An expression that numbers the id ranges in ascending order, and how many numbers there are."""
    n = docs.count()
    points = max(1, min(MOST_PERCENTILES, -(-n // range_rows)))
    inside = max(1, -(-n // (points * range_rows)))
    if points == 1:
        return F.lit(0).cast("long"), 1
    shares = [k / points for k in range(1, points)]
    row = docs.agg(F.percentile_approx("doc_id", shares, 20 * points).alias("p"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    borders = sorted(set(row["p"] or []))
    if not borders:
        return F.lit(0).cast("long"), 1
    table = F.lit(borders)
    steps = [1 << k for k in reversed(range(len(borders).bit_length()))]
    # binary search: how many borders are below the id
    above = F.aggregate(F.lit(steps), F.lit(0), lambda lo, s: F.when((lo + s <= len(borders)) & (F.get(table, lo + s - 1) < F.col("doc_id")), lo + s).otherwise(lo))
    top = F.coalesce(above, F.lit(0)).cast("long")
    if inside == 1:
        return top, len(borders) + 1
    lows = F.lit([row["lo"] - 1, *borders])
    highs = F.lit([*borders, row["hi"]])
    width = let(above, lambda t: (F.col("doc_id") - F.get(lows, t) - 1) / F.greatest(F.lit(1), F.get(highs, t) - F.get(lows, t)))
    return top * inside + F.coalesce(F.least(F.lit(inside - 1), F.floor(width * inside)), F.lit(0)).cast("long"), (len(borders) + 1) * inside


def _moved(firsts: DataFrame) -> DataFrame:
    """``from, to, first``: the range before each range (the last one, before the first), which gets a copy of its first row.

    Ranges are ordered inside blocks of RANGE_BLOCK, and the blocks by one row each, a row for RANGE_ROWS * RANGE_BLOCK documents.
    """
    blocks = firsts.withColumn("block", F.floor(F.col("range") / RANGE_BLOCK))
    inside = blocks.withColumn("before", F.lag("range").over(Window.partitionBy("block").orderBy("range")))
    ends = blocks.groupBy("block").agg(F.max("range").alias("end"))
    order = Window.orderBy("block")
    ends = ends.select("block", F.coalesce(F.lag("end").over(order), F.max("end").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("earlier"))
    return inside.join(ends, "block").select(F.col("range").alias("from"), F.coalesce("before", "earlier").alias("to"), "first")


def dealing_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` partitions a number whose hash deals it there."""
    numbers = spark.range(64 * parts).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("part"))
    found = {r["part"]: r["id"] for r in numbers.groupBy("part").agg(F.min("id").alias("id")).collect()}
    return [found.get(part, part) for part in range(parts)]


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``doc_id, text`` rows (and copies marked ``extra``) with their ``range``, ``rank`` in it and the ``next_text``."""
    number, ranges = id_ranges(docs.select("doc_id"), range_rows)
    dealt = docs.select(number.alias("range"), "doc_id", "text")
    firsts = docs.select(number.alias("range"), "doc_id").groupBy("range").agg(F.min("doc_id").alias("first"))
    moved = _moved(firsts)
    moved = F.broadcast(moved) if ranges <= BROADCAST_RANGES else moved
    copies = dealt.join(moved, (dealt["range"] == moved["from"]) & dealt["doc_id"].eqNullSafe(moved["first"])).select(F.col("to").alias("range"), "doc_id", "text", F.lit(True).alias("extra"))
    both = dealt.withColumn("extra", F.lit(False)).unionByName(copies)
    # Ranges are dealt in turn, so no partition gets more of them than others by the chance of a hash.
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.get(F.lit(dealing_keys(spark, parts)).cast("array<bigint>"), F.pmod("range", F.lit(parts)).cast("int"))
    in_order = Window.partitionBy("key", "range").orderBy("extra", F.col("doc_id").asc_nulls_first(), "tie")
    placed = both.withColumns({"tie": F.xxhash64("text"), "key": key}).repartition(parts, "key")
    return placed.withColumn("rank", F.row_number().over(in_order)).withColumn("next_text", F.lead("text").over(in_order))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's rows: every text, its edited text and the next document, compared by fingerprint."""
    rows = with_next(docs.select(id_of(id_col).alias("doc_id"), text_of(text_col).alias("text")))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - int(floor(char_length(text) / 2)))"), F.left(F.coalesce("next_text", F.lit("")), half))
    rows = rows.select("key", "range", "rank", "extra", "doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), F.when(~F.col("extra"), edited).alias("edited"))
    rows = rows.select("key", "range", "rank", "extra", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), signature(F.col("text")).alias("bins"), F.when(~F.col("extra"), signature(F.col("edited"))).alias("edited_bins"))
    rows = rows.withColumn("next_bins", F.lead("bins").over(Window.partitionBy("key", "range").orderBy("rank"))).filter(~F.col("extra"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    return edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
