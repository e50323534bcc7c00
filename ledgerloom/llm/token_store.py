"""Token-id output as a content-addressed store.

``write_store`` encodes every document, appends the end id and cuts the id stream into content-defined chunks by a
rolling hash over the ids.  The store has three Parquet parts, written by Spark's committer and so safe under retries:

* ``chunks``: ``hash`` (BLAKE2b-128 of the payload), ``n`` and ``payload`` (little-endian ids, 16 bits wide where the
  vocabulary allows it), one row per distinct chunk;
* ``recipes``: documents in ascending (doc_id, recipe hash) order, null ids first, with ``start``, ``n_tokens``, the
  chunk hashes and lengths one after another, and the Merkle root of the chunk hashes;
* ``manifest``: per recipe range its first start, rows, ids and the Merkle root of its documents; a leaf holds a document's
  id, start in the range, number of ids and chunk root;
* ``root``: one row with the number of ranges, rows and ids, and the Merkle root of the manifest's rows.

Both readers first hold the manifest against the root and every range of the recipes against the manifest, so a lost,
added, moved or changed recipe or range raises.  A document's chunks are joined from the recipe's side and held against its
root, so a lost, swapped or changed chunk raises too.  ``read_store`` gives whole id streams back; ``read_digests`` reads
every chunk's bytes back, checks their hashes and folds the chunks' CRC-32 along the recipes, so ids are not moved to their
documents only to be summed up.

Edge cases: a null or empty text is the end id alone; a very long text is many chunks, of at most MOST ids each; repeated
rows each have a recipe and share chunks; rows of one doc_id stand in the order of their recipes' hashes; a null doc_id
sorts first; an empty table gives an empty store; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, id_of, map_batches, shared_dir, slices, text_of
from .tokens import content_cuts, encoder, vocab_path

END_ID = 0
#: A cut falls on one id in 2**MASK_BITS; chunks hold LEAST to MOST ids.
MASK_BITS, LEAST, MOST = 9, 128, 4096
HASH = 16
ROOT = "ranges long, rows long, ids long, root binary"
#: Hashes a task remembers to have sent; chunks that it sends again are dropped after the exchange.
SENT_HASHES = 200_000
#: Documents in a recipe range; bounds the rows that one ordering task holds.
RANGE_ROWS = 20_000


def chunk_hash(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=HASH).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; inner nodes are marked so that none can pass for a leaf."""
    level = [hashlib.blake2b(b"\x00" + x, digest_size=HASH).digest() for x in leaves] or [hashlib.blake2b(b"", digest_size=HASH).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\x01" + level[i] + (level[i + 1] if i + 1 < len(level) else level[i]), digest_size=HASH).digest() for i in range(0, len(level), 2)]
    return level[0]


@lru_cache(maxsize=64)
def _zero_bytes_operator(power: int) -> np.ndarray:
    """CRC-32 register after 2**power zero bytes, as four tables of 256 entries (one per register byte)."""
    if power == 0:
        lowest = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            lowest = (lowest >> np.uint32(1)) ^ np.where(lowest & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
        shifted = np.arange(256, dtype=np.uint32)
        return np.stack([lowest, shifted, shifted << np.uint32(8), shifted << np.uint32(16)])
    half = _zero_bytes_operator(power - 1)
    register = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    return _apply(half, _apply(half, register))


def _apply(operator: np.ndarray, crc: np.ndarray) -> np.ndarray:
    byte = np.uint32(255)
    return operator[0][crc & byte] ^ operator[1][(crc >> np.uint32(8)) & byte] ^ operator[2][(crc >> np.uint32(16)) & byte] ^ operator[3][crc >> np.uint32(24)]


def crc32_joined(crcs: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """CRC-32 of byte strings cut into pieces, from the pieces' CRC-32 and sizes in bytes.

    ``starts`` has the number of each string's first piece; every string has one at least.  CRC-32 is linear, so the
    whole is the exclusive or of the pieces' values, each moved on by the bytes that follow it in its string.
    """
    crcs, ends = crcs.astype(np.uint32), np.cumsum(sizes)
    last = np.append(starts[1:], len(sizes)) - 1
    after = np.repeat(ends[last], np.diff(np.append(starts, len(sizes)))) - ends
    power = 0
    while (after >> power).any():
        moved = (after >> power & 1).astype(bool)
        crcs[moved] = _apply(_zero_bytes_operator(power), crcs[moved])
        power += 1
    return np.bitwise_xor.reduceat(crcs, starts)


def write_store(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the store to ``path``, a folder that every executor reaches; returns the path."""
    vocab, spark = vocab or vocab_path(), docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sent = encoder(vocab), set()
        end = np.array([end_id], dtype=bpe.dtype).tobytes()
        width = bpe.dtype.itemsize
        for part in slices(batches):
            kinds, keys, ids, sizes, bodies, lens = [], [], [], [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                raw = bpe.encode(text) + end
                cuts = content_cuts(bpe.ids(raw), MASK_BITS, LEAST, MOST)
                payloads = [raw[a * width : b * width] for a, b in zip([0, *cuts], cuts)]
                hashes, lengths = [chunk_hash(x) for x in payloads], [b - a for a, b in zip([0, *cuts], cuts)]
                for h, n, payload in zip(hashes, lengths, payloads):
                    if h not in sent:  # seldom twice from a task, once in the store after the exchange by hash
                        if len(sent) >= SENT_HASHES:
                            sent.clear()
                        sent.add(h)
                        kinds.append(1)
                        keys.append(h)
                        ids.append(None)
                        sizes.append(n)
                        bodies.append(payload)
                        lens.append(None)
                recipe = b"".join(hashes)
                kinds.append(0)
                keys.append(chunk_hash(recipe))
                ids.append(doc_id)
                sizes.append(cuts[-1])
                bodies.append(recipe)
                lens.append(np.array(lengths, dtype="<u2").tobytes())
            yield batch_of(kind=pa.array(kinds, pa.int32()), hash=pa.array(keys, pa.binary()), doc_id=pa.array(ids, pa.int64()), n=pa.array(sizes, pa.int64()), body=pa.array(bodies, pa.binary()), lengths=pa.array(lens, pa.binary()))

    schema = "kind int, hash binary, doc_id long, n long, body binary, lengths binary"
    rows = docs.select(id_of(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            keep = []
            for kind, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keep.append(kind == 0 or h != before)
                before = h if kind == 1 else before
            yield batch.filter(pa.array(keep, pa.bool_()))

    # Recipes are spread by document, chunks by hash; equal chunks stand one after another, so no task remembers hashes.
    dealt = rows.repartition(F.when(F.col("kind") == 1, F.xxhash64("hash")).otherwise(F.xxhash64("doc_id", "hash", "kind"))).sortWithinPartitions("kind", "hash")
    dealt.mapInArrow(unique, schema).write.partitionBy("kind").parquet(f"{path}/parts")
    parts = spark.read.parquet(f"{path}/parts") if _has_rows(spark, f"{path}/parts") else spark.createDataFrame([], "hash binary, doc_id long, n long, body binary, lengths binary, kind int")
    _write_recipes(parts.filter("kind = 0").drop("kind"), path)
    return path


def _has_rows(spark: SparkSession, path: str) -> bool:
    try:
        return "kind" in spark.read.parquet(path).columns
    except Exception as error:  # an empty table leaves no partition folder
        if "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise


def _write_recipes(recipes: DataFrame, path: str) -> None:
    """Order recipes by (doc_id, hash) in ranges, and add starts and Merkle roots."""
    spark = recipes.sparkSession
    n = recipes.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    ordered = recipes.withColumnRenamed("body", "hashes").repartitionByRange(ranges, "doc_id", "hash").sortWithinPartitions("doc_id", "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for part in batches:
            counts = np.array(part.column(2).to_pylist(), dtype=np.int64)
            starts = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            roots = [merkle_root([x[i : i + HASH] for i in range(0, len(x), HASH)]) for x in part.column(3).to_pylist()]
            yield batch_of(hash=part.column(0), doc_id=part.column(1), within=pa.array(starts, pa.int64()), n_tokens=part.column(2), hashes=part.column(3), lengths=part.column(4), root=pa.array(roots, pa.binary()))

    schema = "hash binary, doc_id long, within long, n_tokens long, hashes binary, lengths binary, root binary"
    ordered.mapInArrow(run, schema).withColumn("range", F.spark_partition_id()).write.parquet(f"{path}/recipes")
    written = spark.read.parquet(f"{path}/recipes")
    # One row a range (RANGE_ROWS documents) comes to the driver.
    sums = sorted(((r["range"], r["n"], r["rows"]) for r in written.groupBy("range").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).collect()))
    firsts, total = [], 0
    for at, ids, rows in sums:
        firsts.append((at, total, ids, rows))
        total += ids

    roots = _range_roots(written).select("range", "root")
    manifest = spark.createDataFrame(firsts, "range int, first_start long, ids long, rows long").join(roots, "range")
    manifest.coalesce(1).write.parquet(f"{path}/manifest")
    rows = _manifest_rows(spark, path)
    found = [(len(rows), sum(r["rows"] for r in rows), sum(r["ids"] for r in rows), _manifest_root(rows))]
    spark.createDataFrame(found, ROOT).coalesce(1).write.parquet(f"{path}/root")


def _range_roots(recipes: DataFrame) -> DataFrame:
    """``range, ids, rows, root`` of every range, from its documents' rows; a task holds about RANGE_ROWS of them a range."""

    def root_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves: dict[int, list] = {}
        for part in batches:
            for at, within, n, doc_id, root in zip(*(c.to_pylist() for c in part.columns)):
                leaves.setdefault(at, []).append((within, n, b"" if doc_id is None else doc_id.to_bytes(8, "little", signed=True), root))
        found = [(at, sum(x[1] for x in rows), len(rows), merkle_root([b"".join([w.to_bytes(8, "little"), n.to_bytes(8, "little"), root, doc_id]) for w, n, doc_id, root in sorted(rows)])) for at, rows in leaves.items()]
        at, ids, rows, roots = zip(*found) if found else ((), (), (), ())
        yield batch_of(range=pa.array(at, pa.int32()), ids=pa.array(ids, pa.int64()), rows=pa.array(rows, pa.int64()), root=pa.array(roots, pa.binary()))

    return recipes.select("range", "within", "n_tokens", "doc_id", "root").repartition(F.col("range")).mapInArrow(root_of, "range int, ids long, rows long, root binary")


def _manifest_rows(spark: SparkSession, path: str) -> list:
    """The manifest's rows in order, one for RANGE_ROWS documents."""
    return spark.read.parquet(f"{path}/manifest").orderBy("range").collect()


def _manifest_root(rows: list) -> bytes:
    return merkle_root([b"".join([*(r[k].to_bytes(8, "little") for k in ("range", "first_start", "ids", "rows")), bytes(r["root"])]) for r in rows])


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raise unless the manifest has the store's root and every range of the recipes has the manifest's rows, ids and root."""
    rows, root = _manifest_rows(spark, path), spark.read.parquet(f"{path}/root").collect()
    if [(len(rows), sum(r["rows"] for r in rows), sum(r["ids"] for r in rows), _manifest_root(rows))] != [(r["ranges"], r["rows"], r["ids"], bytes(r["root"])) for r in root]:
        raise ValueError("the manifest does not match the store's root")
    before = 0
    for r in rows:
        if r["first_start"] != before:
            raise ValueError(f"range {r['range']} does not start where the one before it ends")
        before += r["ids"]
    kept = spark.read.parquet(f"{path}/manifest").select("range", F.struct("ids", "rows", "root").alias("kept"))
    found = _range_roots(spark.read.parquet(f"{path}/recipes")).select("range", F.struct("ids", "rows", "root").alias("found"))
    wrong = kept.join(found, "range", "full").filter(~F.col("kept").eqNullSafe(F.col("found"))).select("range").limit(10).collect()
    if wrong:
        raise ValueError(f"the recipes of the ranges {sorted(r['range'] for r in wrong)} do not match the manifest")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes with their documents' starts, after a check of the whole manifest."""
    check_manifest(spark, path)
    manifest = spark.read.parquet(f"{path}/manifest").select("range", "first_start")
    recipes = spark.read.parquet(f"{path}/recipes")
    return recipes.join(manifest, "range").withColumn("start", F.col("first_start") + F.col("within")).drop("range", "first_start", "within")


def _chunk_refs(recipes: DataFrame) -> DataFrame:
    """One row per chunk of a document: ``start`` names the document, as no two documents start at the same id."""

    return recipes.select("start", F.posexplode(F.expr(f"transform(sequence(0, length(hashes) - {HASH}, {HASH}), i -> substring(hashes, i + 1, {HASH}))")).alias("number", "hash"))


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    if not _has_rows(spark, f"{path}/parts"):
        return spark.createDataFrame([], "hash binary, n long, body binary")
    return spark.read.parquet(f"{path}/parts").filter("kind = 1").select("hash", "n", "body")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the stored files; a chunk or recipe that fails its hash raises."""

    def check(part: pa.RecordBatch) -> pa.RecordBatch:
        crcs = []
        for h, n, payload in zip(*(c.to_pylist() for c in part.columns)):
            if chunk_hash(payload) != h:
                raise ValueError(f"chunk {h.hex()} does not match its hash")
            crcs.append(zlib.crc32(np.frombuffer(payload, dtype=f"<u{len(payload) // n}").astype("<u4").tobytes()))
        return batch_of(hash=part.column(0), n=part.column(1), crc=pa.array(crcs, pa.int64()))

    checked = map_batches(_chunks(spark, path), check, "hash binary, n long, crc long")
    recipes = _recipes(spark, path)
    used = _chunk_refs(recipes).join(checked.hint("merge"), "hash").groupBy("start").agg(F.collect_list(F.struct("number", "hash", "n", "crc")).alias("used"))

    def fold(part: pa.RecordBatch) -> pa.RecordBatch:
        lists = part.column(5)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        number, h, n, crc = (lists.flatten().field(k) for k in range(4))
        order = np.lexsort((number.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)))
        hashes, lengths = h.take(pa.array(order)).to_pylist(), n.to_numpy()[order]
        for at, start, size, total, root, lens in zip(range(len(sizes)), starts.tolist(), sizes.tolist(), *(part.column(k).to_pylist() for k in (2, 3, 4))):
            _check_document(part.column(1)[at].as_py(), hashes[start : start + size], lengths[start : start + size], total, root, lens)
        crcs = crc32_joined(crc.to_numpy()[order], 4 * lengths, starts) if len(starts) else np.empty(0)
        return batch_of(doc_id=part.column(0), start=part.column(1), n_tokens=part.column(2), ids_crc32=pa.array(crcs.astype(np.int64), pa.int64()))

    return map_batches(recipes.join(used, "start", "left").select("doc_id", "start", "n_tokens", "root", "lengths", "used"), fold, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _check_document(start: int, hashes: list[bytes], lengths: np.ndarray, n_tokens: int, root: bytes, recipe_lengths: bytes) -> None:
    """Raise unless a document's chunks are those of its recipe, all of them, in order and of the recipe's lengths."""
    if not hashes or merkle_root(hashes) != root or int(lengths.sum()) != n_tokens or lengths.astype("<u2").tobytes() != recipe_lengths:
        raise ValueError(f"the document at {start} does not match its recipe")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: every document's id stream (array of int), rebuilt from its chunks."""
    recipes = _recipes(spark, path)
    parts = _chunk_refs(recipes).join(_chunks(spark, path), "hash").groupBy("start").agg(F.collect_list(F.struct("number", "n", "body")).alias("parts"))

    def join(part: pa.RecordBatch) -> pa.RecordBatch:
        streams = []
        for given, start, total, root, lens in zip(*(part.column(k).to_pylist() for k in (5, 1, 2, 3, 4))):
            used = sorted(given or [], key=lambda x: x["number"])
            _check_document(start, [chunk_hash(x["body"]) for x in used], np.array([x["n"] for x in used], dtype=np.int64), total, root, lens)
            streams.append(np.concatenate([np.frombuffer(x["body"], dtype=f"<u{len(x['body']) // x['n']}") for x in used]).astype(np.int32))
        return batch_of(doc_id=part.column(0), start=part.column(1), n_tokens=part.column(2), ids=pa.array(streams, pa.list_(pa.int32())))

    return map_batches(recipes.join(parts, "start", "left").select("doc_id", "start", "n_tokens", "root", "lengths", "parts"), join, "doc_id long, start long, n_tokens long, ids array<int>")


def op3_token_store(spark, sf_dir: str) -> DataFrame:
    path = write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}")
    return read_digests(spark, path)
