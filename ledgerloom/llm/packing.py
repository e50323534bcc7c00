"""Best-fit packing of documents into training sequences, with conflicts.

Documents longer than ``capacity`` are cut into whole sequences and a rest; rests and shorter documents are packed
best-fit decreasing.  A bin carries two bitmaps, of the sources and of the duplicate clusters in it; a document may not
join a bin that has its source or its cluster.  Open bins are held in order of their residual room: the successor
search starts at the smallest residual that fits and goes on until the tightest compatible bin is found; if there is
none, a new bin is opened.

Scale: documents are dealt by a hash into groups of about ``GROUP_ROWS``, each packed by one task, so neither a hot
source nor a large cluster nor a repeated row meets in one task, and every document is placed.  Only ids, lengths, sources
and cluster hashes are exchanged.

Edge cases: a null or empty text is one end id long; a very long text fills sequences of its own; of documents of one length
those with the smaller id (then cluster, then source) come first, and of bins of one residual the older; a null source
conflicts with nothing; repeated rows are placed each; a null doc_id stays null; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, id_of, map_batches, materialise, text_of
from .tokens import encoder, vocab_path

CAPACITY = 4096
GROUP_ROWS = 4096


def measured(docs: DataFrame, vocab: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, n_tokens, cluster``: ids with the end id, and a hash of the case- and space-folded text."""
    vocab = vocab or vocab_path()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe, n, clusters = encoder(vocab), [], []
        for text in part.column(2).to_pylist():
            n.append(bpe.count(text) + 1)
            folded = b" ".join(text.encode("utf-8").lower().split())
            clusters.append(int.from_bytes(hashlib.blake2b(folded, digest_size=8).digest(), "little", signed=True))
        return batch_of(doc_id=part.column(0), source=part.column(1), n_tokens=pa.array(n, pa.int64()), cluster=pa.array(clusters, pa.int64()))

    rows = docs.select(id_of(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), text_of(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, source string, n_tokens long, cluster long")


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (length, source bit or 0, cluster bit or 0); lengths are at most ``capacity``.

    ``items`` are placed in descending length, ties as given.
    """
    placed: list[tuple[int, int]] = [(0, 0)] * len(items)
    order = sorted(range(len(items)), key=lambda i: -items[i][0])
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    for at in order:
        length, source, cluster = items[at]
        successor = bisect_left(open_bins, (length, -1))
        while successor < len(open_bins):
            residual, number = open_bins[successor]
            if not (sources[number] & source or clusters[number] & cluster):
                del open_bins[successor]
                break
            successor += 1
        else:
            residual, number = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        placed[at] = (number, capacity - residual)
        sources[number] |= source
        clusters[number] |= cluster
        if residual > length:
            insort(open_bins, (residual - length, number))
    return placed


def _bits(values: list) -> list[int]:
    """A bit for each distinct value that occurs more than once; a value that occurs once cannot conflict."""
    seen: dict = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    number = {v: at for at, v in enumerate(v for v, n in seen.items() if n > 1 and v is not None)}
    return [1 << number[v] if v in number else 0 for v in values]


def pack(lengths: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, piece, bin_id, bin_offset, n_tokens, source, cluster``: where every piece of every document stands.

    ``lengths`` has ``doc_id, source, n_tokens, cluster`` (as from ``measured``); ``n_tokens`` is at least 1.  It is written
    first, so that a row's number, which deals repeated rows to different groups, is the same in every attempt of a task.
    """
    rows = materialise(lengths.select("doc_id", "source", "n_tokens", "cluster"), "packing-lengths")
    groups = max(1, -(-rows.count() // group_rows))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "cluster", "n_tokens", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        docs = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "source", "n_tokens", "cluster"))))
        rows, rests = [], []
        whole_bins = 0
        for doc_id, source, n, cluster in docs:
            pieces = n // capacity
            for piece in range(pieces):
                rows.append((doc_id, piece, whole_bins, 0, capacity, source, cluster))
                whole_bins += 1
            if n % capacity:
                rests.append((doc_id, pieces, n % capacity, source, cluster))
        bits = zip([r[2] for r in rests], _bits([r[3] for r in rests]), _bits([r[4] for r in rests]))
        for (doc_id, piece, n, source, cluster), (number, offset) in zip(rests, best_fit(list(bits), capacity)):
            rows.append((doc_id, piece, whole_bins + number, offset, n, source, cluster))
        base = key[0].as_py() << 32
        doc, piece, number, offset, n, source, cluster = map(list, zip(*rows))
        return pa.table({
            "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "bin_id": pa.array([base + x for x in number], pa.int64()), "bin_offset": pa.array(offset, pa.int64()),
            "n_tokens": pa.array(n, pa.int64()), "source": pa.array(source, pa.string()), "cluster": pa.array(cluster, pa.int64()),
        })

    return dealt.groupBy("group").applyInArrow(run, "doc_id long, piece int, bin_id long, bin_offset long, n_tokens long, source string, cluster long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, clusters: DataFrame | None = None) -> DataFrame:
    """Measure and pack documents.

    ``clusters`` (``doc_id, cluster``, one row an id, such as the components of ``simhash``) may name near-duplicate clusters;
    documents without one, and all documents by default, are clusters of exact copies.
    """
    lengths = measured(docs)
    if clusters is not None:
        named = clusters.select("doc_id", F.col("cluster").cast("long").alias("named"))
        lengths = lengths.join(named, "doc_id", "left").select("doc_id", "source", "n_tokens", F.coalesce("named", "cluster").alias("cluster"))
    return pack(lengths, capacity)


def op4_best_fit(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
