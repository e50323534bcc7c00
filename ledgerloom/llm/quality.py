"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are read in overlapping chunks that cover all of it.  Each byte has a learned embedding; learned
filters slide over every chunk, are max-pooled within it and rectified; mean and maximum over the chunks, and their
products with learned weights, make one probability.  Trained by Adam, with hand-written gradients, on at most
``SAMPLE_DOCS`` labelled documents a class (a documented bound of the fit only).  The fit, in one task, and the scores read
every byte of a text, a block of chunks at a time.

Edge cases: null and empty texts are one chunk of padding and get a score too; very long texts are more chunks; a score
equal to the threshold is class 1; repeated rows each give their row but are learned from once; a null doc_id is never
learned from; null labels are ignored, and of repeated labels of a document the largest counts; without labels of both
classes the score is that of the one class (0.5 if there are none); an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, id_of, in_one_task, map_batches, materialise, text_of

CHUNK, OVERLAP, STRIDE = 512, 64, 4
FILTER_BYTES, FILTERS, EMBEDDING = 8, 32, 8
SAMPLE_DOCS, EPOCHS, BATCH_DOCS, RATE = 1200, 12, 32, 0.01
#: Documents scored at once hold at most this many chunks in memory.
BLOCK_CHUNKS = 256
THRESHOLD = 0.5
#: A pipeline keeps documents from this score on: below it a text is almost surely bad.
KEEP_FROM = 0.5


def chunks_of(text: str) -> np.ndarray:
    """(chunks, CHUNK) bytes that cover the whole text; zeros fill the last chunk."""
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, dtype=np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.as_strided(padded, shape=(n, CHUNK), strides=(step, 1))


@dataclass
class Network:
    embedding: np.ndarray  # (256, EMBEDDING)
    filters: np.ndarray  # (FILTER_BYTES * EMBEDDING, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,)
    offset: np.ndarray  # (1,)

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        width = FILTER_BYTES * EMBEDDING
        return cls(r.normal(0, 1, (256, EMBEDDING)).astype(np.float32), r.normal(0, width**-0.5, (width, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), r.normal(0, 0.1, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.weights, self.offset]

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, positions, FILTER_BYTES * EMBEDDING)"""
        e = self.embedding[chunks].reshape(len(chunks), -1)
        positions = (CHUNK - FILTER_BYTES) // STRIDE + 1
        return np.lib.stride_tricks.as_strided(e, shape=(len(chunks), positions, FILTER_BYTES * EMBEDDING), strides=(e.strides[0], STRIDE * EMBEDDING * e.itemsize, e.itemsize))

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rectified maximum of every filter in every chunk, and where it stands; a block of chunks at a time."""
        tops, places = [np.empty((0, FILTERS), self.filters.dtype)], [np.empty((0, FILTERS), np.int64)]
        for at in range(0, len(chunks), BLOCK_CHUNKS):
            windows = self.windows(chunks[at : at + BLOCK_CHUNKS])
            answers = (windows.reshape(-1, windows.shape[2]) @ self.filters).reshape(len(windows), windows.shape[1], FILTERS)
            places.append(answers.argmax(axis=1))
            tops.append(np.maximum(np.take_along_axis(answers, places[-1][:, None], axis=1)[:, 0] + self.bias, 0.0))
        return np.concatenate(tops), np.concatenate(places)

    def activations(self, chunks: np.ndarray) -> np.ndarray:
        made = [np.empty((0, FILTERS), np.float32)]
        for at in range(0, len(chunks), BLOCK_CHUNKS):
            windows = self.windows(chunks[at : at + BLOCK_CHUNKS])
            answers = (windows.reshape(-1, windows.shape[2]) @ self.filters).reshape(len(windows), windows.shape[1], FILTERS)
            made.append(np.maximum(answers.max(axis=1) + self.bias, 0.0))
        return np.concatenate(made)

    def scores(self, texts: list[str]) -> np.ndarray:
        """A probability for each text, from all of its bytes."""
        found, waiting, sizes = [], [], []

        def flush() -> None:
            if waiting:
                h = self.activations(np.concatenate(waiting))
                starts = np.cumsum([0, *sizes])[:-1]
                both = np.hstack([np.add.reduceat(h, starts) / np.array(sizes)[:, None], np.maximum.reduceat(h, starts)])
                found.append(sigmoid(both @ self.weights + self.offset))
                waiting.clear()
                sizes.clear()

        for text in texts:
            waiting.append(chunks_of(text))
            sizes.append(len(waiting[-1]))
            if sum(sizes) >= BLOCK_CHUNKS:
                flush()
        flush()
        return np.concatenate(found).astype(np.float64) if found else np.empty(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def gradients(net: Network, chunks: np.ndarray, starts: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted log loss of some documents and its gradient for every parameter."""
    h, where = net.pooled(chunks)
    mean, top = np.add.reduceat(h, starts) / sizes[:, None], np.maximum.reduceat(h, starts)
    both = np.hstack([mean, top])
    p = sigmoid(both @ net.weights + net.offset)
    loss = float(-np.mean(weight * (labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9))))
    ds = (weight * (p - labels) / len(labels)).astype(np.float32)
    d_both = ds[:, None] * net.weights
    doc = np.repeat(np.arange(len(sizes)), sizes)
    d_h = (d_both[:, :FILTERS] / sizes[:, None])[doc]
    is_top = h == top[doc]
    ties = np.add.reduceat(is_top.astype(np.float32), starts)[doc]
    d_h = (d_h + d_both[doc, FILTERS:] * is_top / ties) * (h > 0)
    d_filters, d_embedding = np.zeros_like(net.filters), np.zeros_like(net.embedding)
    rows = np.arange(len(chunks))
    for f in range(FILTERS):
        g = d_h[:, f]
        octets = chunks[rows[:, None], where[:, f][:, None] * STRIDE + np.arange(FILTER_BYTES)]
        d_filters[:, f] = g @ net.embedding[octets].reshape(len(chunks), -1)
        for k in range(FILTER_BYTES):
            d_embedding += np.bincount(octets[:, k], weights=g, minlength=256)[:, None].astype(np.float32) * net.filters[k * EMBEDDING : (k + 1) * EMBEDDING, f]
    return loss, [d_embedding, d_filters, d_h.sum(axis=0), ds @ both, ds.sum(keepdims=True)]


def train(data: list[np.ndarray], labels: list[int], share_of_ones: float | None = None, epochs: int = EPOCHS, seed: int = 0) -> Network:
    """``data``: chunks of each document; ``share_of_ones``: of class 1 among all labels, to which the sample's classes are weighted."""
    net, y = Network.fresh(seed), np.array(labels, dtype=np.float32)
    ones = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or ones in (0.0, 1.0):
        net.weights[:] = 0
        net.offset[:] = {0.0: -4.0, 1.0: 4.0}.get(ones, 0.0) if len(y) else 0.0
        return net
    share = ones if share_of_ones is None else share_of_ones
    weight = np.where(y == 1, share / ones, (1 - share) / (1 - ones)).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    r, step = np.random.default_rng(seed), 0
    total = epochs * -(-len(data) // BATCH_DOCS)
    for _ in range(epochs):
        order = r.permutation(len(data))
        for at in range(0, len(order), BATCH_DOCS):
            picked = order[at : at + BATCH_DOCS]
            sizes = np.array([len(data[i]) for i in picked])
            _, found = gradients(net, np.concatenate([data[i] for i in picked]), np.cumsum([0, *sizes])[:-1], sizes, y[picked], weight[picked])
            step += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * step / total))
            for p, g, (m, v) in zip(net.parameters(), found, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def crc_remainder(modulus: int, id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(id_of(id_col).cast("string").cast("binary")), F.lit(modulus))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_remainder(3, id_col) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, y, n, text``: at most ``sample_docs`` labelled ids a class, by a hash of the id, and the class's size.

    Repeated rows of an id are learned from once: the text with the smallest hash.
    """
    usable = labels.select(id_of(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = docs.select(id_of(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    sizes = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    chosen = [usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).withColumn("n", F.lit(sizes.get(y, 0)).cast("long")) for y in (0, 1)]
    copies = known.join(F.broadcast(materialise(chosen[0].unionByName(chosen[1]), "quality-chosen")), "doc_id")
    return copies.groupBy("doc_id", "y", "n").agg(F.min(F.struct(F.xxhash64("text").alias("tie"), "text")).alias("s")).select("doc_id", "y", "n", "s.text")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Network:
    """Learn from the labels of documents that are not held out, from every byte of the sample's texts, in one task."""

    def learn(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(np.array(table.column("doc_id").to_pylist(), dtype=np.int64), kind="stable")))
        y, sizes = table.column("y").to_pylist(), dict(zip(table.column("y").to_pylist(), table.column("n").to_pylist()))
        net = train([chunks_of(t) for t in table.column("text").to_pylist()], y, sizes.get(1, 0) / max(1, sum(sizes.values())))
        return pa.table({"model": pa.array([pickle.dumps(net)], pa.binary())})

    found = in_one_task(sample(docs, labels, label_col, id_col, text_col, sample_docs), learn, "model binary").first()
    return train([], []) if found is None else pickle.loads(found["model"])


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = net.scores(part.column(2).to_pylist())
        return batch_of(doc_id=part.column(0), held_out=part.column(1), score=pa.array(found, pa.float64()), predicted=pa.array(found >= THRESHOLD).cast(pa.int32()))

    rows = docs.select(id_of(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: Network, text_col: str = "text", least: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``; all columns stay, whatever their names.

    Null texts are scored as empty ones; repeated rows stay or go together; an empty table gives an empty result.
    """
    at = docs.columns.index(text_col)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in part.column(at).cast(pa.string()).to_pylist()]
        return part.filter(pa.array(net.scores(texts) >= least))

    return map_batches(docs, run, docs.schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
