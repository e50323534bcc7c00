"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased code points; TF is a text's relative frequency, IDF comes from the
document frequencies over *all* documents that may be learned from.  Weights are trained by follow-the-regularised-leader
with elastic-net penalties on ``SAMPLE_DOCS`` of these documents, in equal parts of all languages (a documented bound of the
fit only); the bias is then brought to the languages' true shares, and a temperature is calibrated on a fifth of the sample
that the weights have not seen.  The fit runs in one task over the sample's features, at most one number a hashed feature
and document.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing can be learned;
very long texts are read whole, in the fit too; of equally likely languages the first in order is taken; repeated rows
each give their row but are learned from once (the smallest ``lang``, then the smallest text hash); a null doc_id is never
learned from and never held out; rows with a null ``lang`` are not learned from; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, id_of, in_one_task, map_batches, materialise, summed, text_of

ORDERS, FEATURE_BITS = (1, 2, 3), 16
#: The sample has SAMPLE_DOCS documents in equal parts of all languages, but LEAST_DOCS of a language if there are so many.
SAMPLE_DOCS, LEAST_DOCS, EPOCHS, CALIBRATION_SHARE = 3000, 50, 3, 5
#: FTRL: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
SCALE = 30.0
UNDETERMINED = "und"
#: Share of its documents a pipeline keeps out below this confidence.
LEAST_SCORE = 0.5

LETTER = re.compile(r"[^\W\d_]")
SIZE = 1 << FEATURE_BITS
_MULTIPLIERS = {1: (0x9E3779B1,), 2: (0x85EBCA6B, 0xC2B2AE35), 3: (0x27D4EB2F, 0x165667B1, 0x9E3779B1)}


def ngram_features(texts: list[str]) -> list[tuple[np.ndarray, list[int], list[int]]]:
    """For each order: the feature of every n-gram of all texts one after the other, and each text's start and end.

    Two line ends follow each text, so its last characters have n-grams too and none reaches into the next text.
    """
    joined = "".join(t.lower() + "\n\n" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", errors="surrogatepass"), dtype=np.uint32)
    made = []
    lengths = [len(t.lower()) for t in texts]
    starts = np.cumsum([0, *[n + 2 for n in lengths]])[:-1]
    ends = (starts + lengths).tolist()
    for order in ORDERS:
        at = points[: len(points) - order + 1] * np.uint32(_MULTIPLIERS[order][0])
        for k in range(1, order):
            at = at ^ (points[k : len(points) - order + 1 + k] * np.uint32(_MULTIPLIERS[order][k]))
        at ^= at >> np.uint32(15)
        at *= np.uint32(0x2C1B3C6D)
        made.append(((at >> np.uint32(32 - FEATURE_BITS)).astype(np.int32), starts.tolist(), ends))
    return made


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))  # a word character may also be a number such as a superscript


@dataclass
class LanguageModel:
    """``weights`` (feature, language) already hold the IDF and the scale."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        total = np.zeros((len(texts), len(self.languages)), dtype=np.float32)
        count = np.zeros(len(texts))
        for features, starts, ends in ngram_features(texts):
            for at, (start, end) in enumerate(zip(starts, ends)):
                if end > start:
                    total[at] += self.weights[features[start:end]].sum(axis=0)
                    count[at] += end - start
        logits = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        readable = [bool(t) and has_letter(t) for t in texts]
        asked = [t for t, ok in zip(texts, readable) if ok]
        if not self.languages or not asked:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        p = iter(self.probabilities(asked))
        found = [(self.languages[int(np.argmax(x))], float(np.max(x))) if ok and (x := next(p)) is not None else (UNDETERMINED, 0.0) for ok in readable]
        return [a for a, _ in found], [b for _, b in found]


def held_out(id_col: str = "doc_id"):
    """The documents that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_of(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and the number of documents."""

    def count(part: pa.RecordBatch) -> np.ndarray:
        found, texts = np.zeros(SIZE + 1, dtype=np.int64), part.column(0).to_pylist()
        found[SIZE] = len(texts)
        made = ngram_features(texts)
        for at in range(len(texts)):
            seen = np.zeros(SIZE, dtype=bool)
            for features, starts, ends in made:
                seen[features[starts[at] : ends[at]]] = True
            found[:SIZE] += seen
        return found

    counted = summed(docs.select(text_of(text_col).alias("text")), count, SIZE + 1)
    return counted[:SIZE].astype(float), int(counted[SIZE])


def feature_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's features and how often each occurs."""
    return np.unique(np.concatenate([f[s[0] : e[0]] for f, s, e in ngram_features([text])]), return_counts=True)


def tf_idf(features: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (SCALE * counts / max(1, counts.sum()) * idf[features]).astype(np.float32)


def final_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights from the sums of gradients and of their squares; small sums give exact zeros."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(counted: list[tuple[np.ndarray, np.ndarray]], langs: list[str], idf: np.ndarray, epochs: int = EPOCHS, shares: dict[str, float] | None = None) -> LanguageModel:
    """FTRL-proximal with one weight vector a language, softmax loss, then a temperature on every fifth row.

    ``counted`` has the features and counts of each text.  ``shares`` are the languages' true shares, if the rows have other
    ones: the bias and the calibration are brought to them.
    """
    languages = sorted(set(langs))
    if not languages:
        return LanguageModel([], np.zeros((SIZE, 0), np.float32), np.zeros(0), 1.0)
    target = [languages.index(x) for x in langs]
    fit = [i for i in range(len(target)) if i % CALIBRATION_SHARE or len(target) < 10 * CALIBRATION_SHARE]
    held = [i for i in range(len(target)) if not i % CALIBRATION_SHARE]
    k = len(languages)
    z, n = np.zeros((SIZE + 1, k)), np.zeros((SIZE + 1, k))
    order = np.random.default_rng(0)

    def row(i: int) -> tuple[np.ndarray, np.ndarray]:
        features, counts = counted[i]
        return np.append(features, SIZE).astype(np.int32), np.append(tf_idf(features, counts, idf), np.float32(1.0))

    for _ in range(epochs):
        for i in order.permutation(fit):
            at, x = row(i)
            w = final_weights(z[at], n[at])
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[target[i]] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    final = final_weights(z, n)
    own = np.bincount(target, minlength=k) / len(target)
    prior = np.ones(k) if shares is None else np.array([shares[x] for x in languages]) / own
    final[SIZE] += np.log(prior)
    logits = np.array([row(i)[1] @ final[row(i)[0]] for i in held])
    weight, at = prior[[target[i] for i in held]], (np.arange(len(held)), [target[i] for i in held])
    best = (np.inf, 1.0)
    for t in np.geomspace(0.1, 5.0, 60):
        s = logits / t
        s -= s.max(axis=1, keepdims=True)
        loss = -np.average(s[at] - np.log(np.exp(s).sum(axis=1)), weights=weight)
        best = min(best, (float(loss), float(t)))
    return LanguageModel(languages, (final[:SIZE] * idf[:, None] * SCALE).astype(np.float32), final[SIZE], best[1])


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, lang, text, n``: an equal number of distinct ids of every language, by a hash, and the language's size.

    Repeated rows of an id count once: its smallest language, and of that the text with the smallest hash.
    """
    ids = docs.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    sizes = materialise(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langid-sizes")
    quota = max(LEAST_DOCS, -(-sample_docs // max(1, sizes.count())))
    # Of a common language only ids with a small hash can be among the first: four times as many as wanted are ordered.
    far = F.least(F.lit(1.0), F.lit(4.0 * quota + 1000) / F.col("n"))
    near = ids.join(sizes, "lang").filter(F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 <= far)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = materialise(near.withColumn("nth", nth).filter(F.col("nth") <= quota).select("doc_id", "lang", "n"), "langid-chosen")
    copies = docs.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "n", "text")
    return copies.groupBy("doc_id", "lang", "n").agg(F.min(F.struct(F.xxhash64("text").alias("tie"), "text")).alias("s")).select("doc_id", "lang", "s.text", "n")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Learn from the documents that are not held out and have a language; one task holds the sample's features."""
    usable = docs.select(id_of(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    frequencies, n_docs = document_frequencies(usable)
    idf = np.log((1.0 + n_docs) / (1.0 + frequencies)) + 1.0

    def counted(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [feature_counts(t) for t in part.column(2).to_pylist()]
        return batch_of(doc_id=part.column(0), lang=part.column(1), n=part.column(3), features=pa.array([f for f, _ in found], pa.list_(pa.int32())), counts=pa.array([n for _, n in found], pa.list_(pa.int32())))

    def learn(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table.column("doc_id").to_pylist(), dtype=np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        langs, sizes = table.column("lang").to_pylist(), dict(zip(table.column("lang").to_pylist(), table.column("n").to_pylist()))
        pairs = [(f.values.to_numpy(), n.values.to_numpy()) for f, n in zip(table.column("features"), table.column("counts"))]
        made = train(pairs, langs, idf, shares={x: n / sum(sizes.values()) for x, n in sizes.items()})
        return pa.table({"model": pa.array([pickle.dumps(made)], pa.binary())})

    rows = map_batches(sample(usable, sample_docs), counted, "doc_id long, lang string, n long, features array<int>, counts array<int>")
    found = in_one_task(rows, learn, "model binary").first()
    return train([], [], idf) if found is None else pickle.loads(found["model"])


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found, scores = model.predict(part.column(2).to_pylist())
        return batch_of(doc_id=part.column(0), held_out=part.column(1), lang_pred=pa.array(found, pa.string()), score=pa.array(scores, pa.float64()))

    rows = docs.select(id_of(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_readable(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is found with at least ``least`` confidence; all columns stay, whatever their names.

    Null texts and texts without a letter go; repeated rows stay or go together; an empty table gives an empty result.
    """
    at, schema = docs.columns.index(text_col), docs.schema

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found, scores = model.predict(part.column(at).cast(pa.string()).to_pylist())
        return part.filter(pa.array([a != UNDETERMINED and b >= least for a, b in zip(found, scores)], pa.bool_()))

    return map_batches(docs, run, schema)


def op8_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
