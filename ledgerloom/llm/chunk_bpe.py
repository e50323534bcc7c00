"""BPE encoding and decoding with content-defined chunk reuse.

Distinct texts are cut into chunks by a rolling hash, so passages that documents share are cut alike.  A chunk that
occurs more than once in the corpus is encoded once, by its owner (the smallest ``(text key, chunk number)``), and its
ids are joined to every other place.  A chunk encoded alone may differ from the same bytes inside a text near its two
ends only.  Each join is therefore re-encoded in a window that reaches into both neighbours and grows until its first
and last pre-tokens have exactly the ids that the neighbours hold for them.  Window ends are places where a space
stands before a letter: byte-level BPE splits there whatever the context, so agreement there is agreement everywhere.

Scale: texts are exchanged once, by a hash of them; copies of a text collapse before that exchange.  Chunk lists carry
16-byte hashes only, and ids move only for chunks that occur more than once.

Edge cases: null and empty texts have no ids and decode to the empty text; a very long text is many chunks, encoded one by
one; of several uses of a chunk the smallest (text key, chunk number) owns it; repeated rows each
give their row; a text without any chunk cut is one chunk; a null doc_id stays null; an empty table gives an empty result;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, id_of, map_batches, text_of
from .tokens import PreTokenEncoder, content_cuts, encoder, vocab_path

#: A cut falls on one byte in 2**MASK_BITS; chunks hold LEAST to MOST bytes.
MASK_BITS, LEAST, MOST = 10, 256, 8192
KEY_BYTES = 16
DIGESTS = "key binary, n_tokens long, ids_sha256 binary, decoded_sha256 binary"


def chunks_of(raw: bytes) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a UTF-8 text; no chunk starts inside a character."""
    ends, spans, start = content_cuts(np.frombuffer(raw, dtype=np.uint8), MASK_BITS, LEAST, MOST), [], 0
    for end in ends:
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        if end > start:
            spans.append((start, end))
            start = end
    return spans


def chunk_hash(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def sync_points(raw: bytes) -> np.ndarray:
    """Offsets of a space before an ASCII letter: pre-token borders in any context."""
    b = np.frombuffer(raw, dtype=np.uint8)
    if len(b) < 2:
        return np.empty(0, dtype=np.int64)
    lower = b[1:] | 0x20
    return np.flatnonzero((b[:-1] == 0x20) & (lower >= 0x61) & (lower <= 0x7A))


class Segment:
    """Part of a text with the ids it has when encoded alone, and the byte offset of each id's end."""

    def __init__(self, bpe: PreTokenEncoder, start: int, end: int, ids: np.ndarray, syncs: np.ndarray):
        self.start, self.end, self.ids = start, end, ids
        self.ends = np.cumsum(bpe.lengths[ids]) + start
        self.syncs = syncs[np.searchsorted(syncs, start) : np.searchsorted(syncs, end - 1)].tolist()

    def between(self, a: int, b: int) -> np.ndarray:
        """Ids of the bytes from a to b, both borders of ids."""
        return self.ids[0 if a == self.start else np.searchsorted(self.ends, a) + 1 : np.searchsorted(self.ends, b) + 1 if b > self.start else 0]


def assemble(bpe: PreTokenEncoder, raw: bytes, shared: dict[int, bytes]) -> np.ndarray:
    """Ids of a text from the ids of its shared chunks (by number); the rest is encoded here and the joins are repaired."""
    if not shared:
        return bpe.ids(bpe.encode(raw.decode("utf-8")))
    spans, syncs, parts, run = chunks_of(raw), sync_points(raw), [], None
    for at, (start, end) in enumerate(spans):
        if at in shared:
            if run is not None:
                parts.append(Segment(bpe, run, start, bpe.ids(bpe.encode(raw[run:start].decode("utf-8"))), syncs))
                run = None
            parts.append(Segment(bpe, start, end, bpe.ids(shared[at]), syncs))
        elif run is None:
            run = start
    if run is not None:
        parts.append(Segment(bpe, run, len(raw), bpe.ids(bpe.encode(raw[run:].decode("utf-8"))), syncs))
    return repaired(bpe, raw, parts)


def repaired(bpe: PreTokenEncoder, raw: bytes, parts: list[Segment]) -> np.ndarray:
    """Join segments; ``out`` holds confirmed ids up to the byte ``done`` of the segment ``left``."""
    out, left, done = [], parts[0], 0
    at = 1
    while at < len(parts):
        # window from a sync point of the left segment (or what is confirmed) to one of the right segment (or the text's end)
        lefts = [x for x in left.syncs if x > done] if left is not None else []
        step, right = 0, at
        while True:
            a = lefts[-2 - step] if len(lefts) > 1 + step else done
            inner_a = lefts[-1 - step] if len(lefts) > step else a
            while right < len(parts) and len(parts[right].syncs) < 2 + step:
                right += 1
                step = 0
            b, inner_b = (parts[right].syncs[1 + step], parts[right].syncs[step]) if right < len(parts) else (len(raw), len(raw))
            window = bpe.ids(bpe.encode(raw[a:b].decode("utf-8")))
            agrees = True
            if left is not None and inner_a > a:
                own = left.between(a, inner_a)
                agrees = np.array_equal(window[: len(own)], own)
            if agrees and right < len(parts) and b > inner_b:
                own = parts[right].between(inner_b, b)
                agrees = np.array_equal(window[len(window) - len(own) :], own)
            if agrees or (a == done and right == len(parts)):
                break
            step += 1
        if left is not None and a > done:
            out.append(left.between(done, a))
        out.append(window)
        if right == len(parts):
            return np.concatenate(out)
        left, done, at = parts[right], b, right + 1
    out.append(left.between(done, left.end))
    return np.concatenate(out)


def text_key(text: Column) -> Column:
    """The first KEY_BYTES bytes of the text's SHA-256."""
    return F.coalesce(F.substring(F.unhex(F.sha2(text, 256)), 1, KEY_BYTES), F.lit(bytearray()))


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``key`` (from the SHA-256 of the text) and ``text``, one row per text; copies collapse before the exchange."""
    # A key that cannot be null needs no null test, which would keep the two uses of this exchange from sharing it.
    return docs.select(text_of(text_col).alias("text")).select(text_key(F.col("text")).alias("key"), "text").dropDuplicates(["key"])


def encode(docs: DataFrame, vocab: str | None = None, text_col: str = "text") -> DataFrame:
    """``key, ids``: the little-endian ids of every distinct text, each shared chunk being encoded once."""
    return _encoded(docs, vocab or vocab_path(), text_col, _ids_rows, "key binary, ids binary")


def encode_digests(docs: DataFrame, vocab: str | None = None, text_col: str = "text") -> DataFrame:
    """``digests(encode(docs))`` in one Python stage, so a task holds one encoder and ids don't leave their worker."""
    return _encoded(docs, vocab or vocab_path(), text_col, _digest_rows, DIGESTS)


def _ids_rows(bpe: PreTokenEncoder, keys: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    return batch_of(key=keys, ids=pa.array([x.tobytes() for x in ids], pa.binary()))


def _digest_rows(bpe: PreTokenEncoder, keys: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    ids_sha = [hashlib.sha256(x.astype("<u4").tobytes()).digest() for x in ids]
    text_sha = [hashlib.sha256(bpe.decode(x).encode("utf-8")).digest() for x in ids]
    return batch_of(key=keys, n_tokens=pa.array([len(x) for x in ids], pa.int64()), ids_sha256=pa.array(ids_sha, pa.binary()), decoded_sha256=pa.array(text_sha, pa.binary()))


def _encoded(docs: DataFrame, vocab: str, text_col: str, rows_of: Callable[[PreTokenEncoder, pa.Array, list[np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    texts = distinct_texts(docs, text_col)

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        keys, numbers, hashes = [], [], []
        for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            raw = text.encode("utf-8")
            for number, (start, end) in enumerate(chunks_of(raw)):
                keys.append(key)
                numbers.append(number)
                hashes.append(chunk_hash(raw[start:end]))
        return batch_of(key=pa.array(keys, pa.binary()), number=pa.array(numbers, pa.int32()), hash=pa.array(hashes, pa.binary()))

    uses = map_batches(texts, cut, "key binary, number int, hash binary")
    shared = uses.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "number")).alias("owner")).filter("n > 1")
    owned = shared.groupBy(F.col("owner.key").alias("key")).agg(F.collect_list(F.struct(F.col("owner.number").alias("number"), "hash")).alias("own"))

    def encode_owned(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe, hashes, ids = encoder(vocab), [], []
        for text, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            raw = text.encode("utf-8")
            spans = chunks_of(raw)
            for one in own:
                start, end = spans[one["number"]]
                hashes.append(one["hash"])
                ids.append(bpe.encode(raw[start:end].decode("utf-8")))
        return batch_of(hash=pa.array(hashes, pa.binary()), ids=pa.array(ids, pa.binary()))

    once = map_batches(texts.join(owned, "key").select("text", "own"), encode_owned, "hash binary, ids binary")
    # A hot chunk's uses are 40-byte rows; adaptive execution splits them, as the join is a sort-merge join of two exchanges.
    reused = uses.join(once.hint("merge"), "hash").groupBy("key").agg(F.collect_list(F.struct("number", "ids")).alias("shared"))

    def finish(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(vocab)
        ids = [assemble(bpe, text.encode("utf-8"), {x["number"]: x["ids"] for x in given or ()}) for text, given in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
        return rows_of(bpe, part.column(0), ids)

    return map_batches(texts.join(reused, "key", "left").select("key", "text", "shared"), finish, schema)


def decode(encoded: DataFrame, vocab: str | None = None) -> DataFrame:
    """``key, text`` from ``key, ids``."""
    vocab = vocab or vocab_path()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(vocab)
        return batch_of(key=part.column(0), text=pa.array([bpe.decode(bpe.ids(x)) for x in part.column(1).to_pylist()], pa.string()))

    return map_batches(encoded.select("key", "ids"), run, "key binary, text string")


def digests(encoded: DataFrame, vocab: str | None = None) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of encoded texts; the ids are decoded here, whole."""
    vocab = vocab or vocab_path()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(vocab)
        return _digest_rows(bpe, part.column(0), [bpe.ids(x) for x in part.column(1).to_pylist()])

    return map_batches(encoded.select("key", "ids"), run, DIGESTS)


def op2_chunk_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = encode_digests(docs)
    keyed = docs.select(id_of().alias("doc_id"), text_key(text_of()).alias("key"))
    return keyed.join(found.hint("merge"), "key").select("doc_id", "n_tokens", F.lower(F.hex("ids_sha256")).alias("ids_sha256"), F.lower(F.hex("decoded_sha256")).alias("decoded_sha256"))
