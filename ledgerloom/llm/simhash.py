"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into three segments.  Two fingerprints that differ in at most four bits differ in at most one bit
in some segment, so there they agree on a *variant*: the segment with one wildcard bit.  If no segment is equal, two of
them differ in exactly one bit, so variants of the first two segments are enough, beside the three segments as they are.
To keep unlike fingerprints apart in a large corpus, a key also holds a block of the bits outside its segment: of five
blocks one is equal if the segment is (four differences are left at most), of four blocks one is equal beside a variant
whose wildcard bit differs (three are left).  All 183 keys of every distinct fingerprint are indexed; equal keys, of
about 30 bits, meet by an equality join and the whole distance verifies them.

Groups: copies collapse to one fingerprint before the index.  A first round takes only the 15 keys of equal segments and
compares every member of a group with the group's smallest fingerprint.  The 168 variant keys then keep only groups that
still hold different components and both values of the wildcard bit (a pair that agrees on it has an equal segment and met
in the first round), so neither joined near copies nor chance groups of a crowded neighbourhood leave rows there.  A group
of two is settled by its sums.  Members of larger ones are compared with the smallest one in turn, and the pairs join emits
a pair only if its members are in different components even then.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, four-word shingles joined by a space (all words if fewer),
XXH64 with seed 42 of each, repeats included; a bit is 1 if set in more than half of them; no words: zero.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; very long texts are read whole, their
hashes summed up in blocks; a bit set in exactly half of the hashes is 0; repeated rows each give their row; null ids are
never the smallest id unless a component has none (then its id is null); an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_of, id_of, map_batches, materialise, text_of

SHINGLE_WORDS, SEED, DISTANCE = 4, 42, 4
#: Links in a file of a round of the components, and its files at least.
TASK_LINKS, LEAST_FILES = 250_000, 8
#: (lowest bit, bits) of the segments
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of a text."""
    import xxhash

    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE_WORDS]), SEED) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(octets), 1 << 14):
        ones += np.unpackbits(octets[at : at + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tie, fp``: the fingerprint as a signed long; ``tie`` is a hash of the text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x) for x in part.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
        return batch_of(doc_id=part.column(0), tie=part.column(1), fp=pa.array(found, pa.int64()))

    return map_batches(docs.select(id_of(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("tie"), text_of(text_col).alias("text")), run, "doc_id long, tie long, fp long")


def tables() -> list[dict[str, int]]:
    """The index's tables: how a key is taken from a fingerprint.

    ``lowest`` and ``mask`` name the segment (its wildcard bit left out of the mask), ``above``, ``below`` and ``raised``
    bring the bits outside the segment together, ``shift``, ``bits`` and ``block`` name a block of them; ``wild`` is the
    wildcard bit (0: none).
    """
    made: list[dict[str, int]] = []
    for at, (lowest, width) in enumerate(SEGMENTS):
        wildcards = [None, *range(width)] if at < 2 else [None]
        for wildcard in wildcards:
            count = DISTANCE + 1 if wildcard is None else DISTANCE
            left = 64 - width
            for number in range(count):
                bits = -(-left // (count - number))
                left -= bits
                made.append({
                    "lowest": lowest, "mask": ((1 << width) - 1) & ~(0 if wildcard is None else 1 << wildcard), "above": (lowest + width) % 64,
                    "raised": (1 << (64 - width)) - (1 << lowest) if lowest + width < 64 else 0, "below": (1 << lowest) - 1, "shift": left, "bits": bits, "block": (1 << bits) - 1, "table": len(made) << 40,
                    "wild": 0 if wildcard is None else 1 << (lowest + wildcard),
                })
    return made


def variants(fp: str, plain: bool | None = None) -> Column:
    """Array of a fingerprint column's keys: table number, then the segment (its wildcard bit cleared, if any), then a block.

    ``plain``: only those of whole segments, or (false) only those with a wildcard bit.
    """
    wide = {"mask", "raised", "below", "block", "table"}
    structs = [", ".join(f"'{k}', {v}{'L' if k in wide else ''}" for k, v in t.items() if k != "wild") for t in tables() if plain is None or plain == (t["wild"] == 0)]
    listed = "array(" + ", ".join(f"named_struct({x})" for x in structs) + ")"
    rest = f"((shiftleft(shiftrightunsigned({fp}, t.above), t.lowest) & t.raised) | ({fp} & t.below))"
    key = f"t.table | shiftleft(shiftrightunsigned({fp}, t.lowest) & t.mask, t.bits) | (shiftrightunsigned({rest}, t.shift) & t.block)"
    return F.expr(f"transform({listed}, t -> {key})")


def connected_components(edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``node, root`` (smallest node) for every node of ``a, b`` links, by alternating large and small stars.

    Any number of links goes through the same rounds over all tasks, until every node hangs on its root; their number grows
    with the logarithm of the largest component's diameter.  Each round is written, in files of about ``task_links``
    links, so a lost executor costs no earlier round.
    """
    with Scratch(edges.sparkSession, "links") as scratch:
        links = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), small=True)
        links = materialise(_starred(links, scratch, task_links), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _starred(links: DataFrame, scratch: Scratch, task_links: int) -> DataFrame:
    """Every node of the links, each from the greater to the smaller node, with its component's smallest node."""
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = both.groupBy("a").agg(F.count_if(F.col("b") < F.col("a")).alias("up"), F.count_if(F.col("b") > F.col("a")).alias("down"))
        state = ends.agg(F.sum("up").alias("n"), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).alias("unfinished")).first()
        if not state["unfinished"]:
            return links
        files = max(LEAST_FILES, -(-state["n"] // task_links))
        # Minima are written: a join with a written table deals a hub's links anew or sends the minima, so no task has to hold a hub.
        least = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(files))
        large = scratch.write(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(files))
        least = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(files))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        links = scratch.write(small.distinct().coalesce(files))


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def classes(signed: DataFrame) -> DataFrame:
    """``fp, root``: every distinct fingerprint of ``signed`` and its component's name."""
    with Scratch(signed.sparkSession, "simhash") as scratch:
        return materialise(_classes(signed, scratch), "simhash-classes")


def _met(nodes: DataFrame, plain: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``key, fp, centre`` of the groups of ``fp, root`` that hold different roots, and links of their members.

    A pair that agrees on the wildcard bit of a key has an equal segment and met by it before, so a group of a variant
    counts only if its members differ in that bit.  Of two members the sums tell the distance: no join has to bring them.
    """
    # Fingerprints are small but become up to 168 rows each, so they are dealt by number and not by size.
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    indexed = nodes.repartition(tasks, F.xxhash64("fp")).select("fp", "root", F.explode(variants("fp", plain)).alias("key"))
    sums = indexed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("centre"), F.min("root").alias("least"), F.max("root").alias("most"), F.expr("bit_or(fp) ^ bit_and(fp)").alias("differ"))
    wild = F.expr("array(" + ", ".join(f"{t['wild']}L" for t in tables()) + ")[int(shiftright(key, 40))]")
    apart = (F.col("least") < F.col("most")) & ((wild == 0) | (F.col("differ").bitwiseAND(wild) != 0)) & ((F.col("n") > 2) | (F.bit_count("differ") <= DISTANCE))
    # Sums of a key meet in one task, its members need not: a join deals them again.
    mixed = scratch.write(sums.filter(apart).select("key", "n", "centre", "differ"))
    groups = scratch.write(indexed.select("key", "fp").join(mixed.filter("n > 2").select("key", "centre").hint("merge"), "key"))
    twos = mixed.filter("n = 2").select(F.col("centre").bitwiseXOR(F.col("differ")).alias("a"), F.col("centre").alias("b"))
    stars = groups.filter((F.col("fp") != F.col("centre")) & (_apart("fp", "centre") <= DISTANCE)).select(F.col("fp").alias("a"), F.col("centre").alias("b"))
    return groups.select("key", "fp"), scratch.write(twos.unionByName(stars).distinct(), small=True)


def _named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``fp, root`` of ``nodes`` (``fp, root``) after some more links."""
    joined = links.unionByName(nodes.filter("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b")))
    return nodes.select("fp").join(connected_components(joined).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def _classes(signed: DataFrame, scratch: Scratch) -> DataFrame:
    nodes = scratch.write(signed.select("fp").distinct().select("fp", F.col("fp").alias("root")))
    whole, links = _met(nodes, True, scratch)
    nodes = scratch.write(_named(nodes, links))
    varied, links = _met(nodes, False, scratch)
    nodes = scratch.write(_named(nodes, links))
    labelled = scratch.write(whole.unionByName(varied).join(nodes, "fp"))
    left, right = labelled.alias("l"), labelled.alias("r")
    pairs = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.root") < F.col("r.root")) & (_apart("l.fp", "r.fp") <= DISTANCE)).select(F.col("l.root").alias("a"), F.col("r.root").alias("b")).distinct()
    return _named(nodes, pairs)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tie, fp, component_id`` for every row.

    Smallest ids are taken by fingerprint, then by component, so documents are dealt by fingerprint once and only for a
    join with one row a fingerprint, whose crowded keys Spark can split.
    """
    signed = materialise(signatures(docs, id_col, text_col), "simhash")
    smallest = signed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = materialise(smallest.join(classes(signed), "fp"), "simhash-classes")
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return signed.join(named.join(component, "root").select("fp", "component_id"), "fp").select("doc_id", "tie", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, by the rule of the pipeline's stage: five words, Jaccard 0.8."""
    from .near_copies import keep_one as keep

    return keep(docs, id_col, text_col)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
