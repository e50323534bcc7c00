"""The numeric operators against plain loops, and the fits and stages on hostile input."""

import math
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import langid, media, minhash, packing, quality

from .conftest import SCHEMA, TINY


def chained(values, seed=42):
    """Spark's hash of several longs: each is hashed with the hash before it as the seed."""
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def plain_minhash(text):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in text.lower().split()]
    if not words:
        return ""
    best = {}
    for i in range(max(1, len(words) - 4)):
        h = chained([w for w in words[i : i + 5]], 42) % (1 << 64)
        at, value = h >> 57, h & ((1 << 56) - 1)
        best[at] = min(best.get(at, value), value)
    code = {at: value & 255 for at, value in best.items()}
    for empty in [b for b in range(128) if b not in best]:
        code[empty] = min((chained([empty, at]) & ~255) | (best[at] & 255) for at in best) & 255
    return "".join(f"{code[b]:02x}" for b in range(128))


def test_op6_bits_equal_plain_minhash(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)] + ["Ünï", "ABC"]
    texts = ["", "one", "two words", *(" ".join(r.choices(words, k=n)) for n in (4, 5, 6, 40, 120, 900))]
    found = minhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["fingerprint"] for x in found} == {i: plain_minhash(t) for i, t in enumerate(texts)}


def plain_probability(net, text):
    """The network by loops over chunks, positions and filters."""
    raw = text.encode()
    step = quality.CHUNK - quality.OVERLAP
    starts = [0]
    while starts[-1] + quality.CHUNK < len(raw):
        starts.append(starts[-1] + step)
    pooled = []
    for s in starts:
        chunk = raw[s : s + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        tops = []
        for f in range(quality.FILTERS):
            answers = []
            for at in range(0, quality.CHUNK - quality.FILTER_BYTES + 1, quality.STRIDE):
                answers.append(sum(float(net.embedding[chunk[at + k], e]) * float(net.filters[k * quality.EMBEDDING + e, f]) for k in range(quality.FILTER_BYTES) for e in range(quality.EMBEDDING)))
            tops.append(max(0.0, max(answers) + float(net.bias[f])))
        pooled.append(tops)
    both = [sum(c) / len(c) for c in zip(*pooled)] + [max(c) for c in zip(*pooled)]
    return 1 / (1 + math.exp(-(sum(a * float(w) for a, w in zip(both, net.weights)) + float(net.offset[0]))))


def test_op7_scores_equal_plain_loops():
    net = quality.Network.fresh(5)
    net.bias[:] = np.random.default_rng(1).normal(0, 0.2, quality.FILTERS)
    for text in ("", "short text", "é" * 300 + " and more than one chunk " * 20):
        assert net.scores([text])[0] == pytest.approx(plain_probability(net, text), abs=1e-4)


def test_op7_learns_from_both_classes_whatever_is_repeated(spark):
    """Ten thousand copies of one labelled row, in any partitioning, weigh as one."""
    r = random.Random(3)
    ids = [i for i in range(400) if not quality_held_out(i)][:60]
    rows = [(i, ("clean prose that goes on " if n % 2 else "!!! $$$ ### buy ") * r.randint(3, 30)) for n, i in enumerate(ids)]
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id long, quality int")
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    copies = spark.range(10_000).select(F.lit(rows[0][0]).cast("long").alias("doc_id"), F.lit(rows[0][1]).alias("text"))
    nets = [quality.fit(t, labels, sample_docs=40) for t in (plain, plain.unionByName(copies).repartition(7), plain.unionByName(copies).repartition(2).sortWithinPartitions(F.desc("doc_id")))]
    for net in nets[1:]:
        assert all(np.array_equal(a, b) for a, b in zip(nets[0].parameters(), net.parameters()))
    assert nets[0].scores([rows[1][1]])[0] > 0.5 > nets[0].scores([rows[0][1]])[0]
    sampled = quality.sample(plain.unionByName(copies), labels, sample_docs=40)
    assert sampled.count() == 60 and {x["n"] for x in sampled.collect()} == {30}


def quality_held_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 3 == 1


def plain_ftrl(rows, target, k, idf, order):
    """FTRL-proximal one coordinate after another; ``rows`` are dicts of feature values with the bias at -1."""
    z, n = {}, {}

    def weight(f, c):
        if abs(z.get((f, c), 0.0)) <= langid.L1:
            return 0.0
        v = z[f, c]
        return -(v - math.copysign(langid.L1, v)) / ((langid.BETA + math.sqrt(n.get((f, c), 0.0))) / langid.ALPHA + langid.L2)

    for i in order:
        x = rows[i]
        w = {(f, c): weight(f, c) for f in x for c in range(k)}
        logits = [sum(v * w[f, c] for f, v in x.items()) for c in range(k)]
        e = [math.exp(v - max(logits)) for v in logits]
        for c in range(k):
            d = e[c] / sum(e) - (c == target[i])
            for f, v in x.items():
                g, before = v * d, n.get((f, c), 0.0)
                z[f, c] = z.get((f, c), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / langid.ALPHA * w[f, c]
                n[f, c] = before + g * g
    return weight


def test_op8_training_equals_plain_ftrl():
    r = random.Random(4)
    words = {"en": ["the", "and", "with"], "de": ["und", "der", "mit"], "fr": ["le", "est", "avec"]}
    langs = [r.choice(sorted(words)) for _ in range(70)]
    texts = [" ".join(r.choices(words[x] if r.random() < 0.85 else words["en"], k=12)) for x in langs]
    counted = [langid.feature_counts(t) for t in texts]
    idf = np.linspace(1, 2, langid.SIZE)
    model = langid.train(counted, langs, idf, epochs=2)
    fit = [i for i in range(70) if i % langid.CALIBRATION_SHARE]
    generator = np.random.default_rng(0)
    order = [i for _ in range(2) for i in generator.permutation(fit)]
    rows = [dict(zip(f.tolist(), langid.tf_idf(f, n, idf).tolist())) | {-1: 1.0} for f, n in counted]
    target = [model.languages.index(x) for x in langs]
    weight = plain_ftrl(rows, target, 3, idf, order)
    used = sorted({f for x in rows for f in x if f >= 0})
    for f in used:
        for c in range(3):
            assert model.weights[f, c] == pytest.approx(weight(f, c) * idf[f] * langid.SCALE, rel=2e-3, abs=2e-3)
    assert np.all(model.weights[[f for f in range(langid.SIZE) if f not in set(used)]] == 0)
    exact_zeros = sum(weight(f, c) == 0.0 for f in used for c in range(3))
    assert exact_zeros > 0 and exact_zeros == int((model.weights[used] == 0).sum())
    # the temperature has the least loss of its grid on the held-out fifth
    held = [i for i in range(70) if not i % langid.CALIBRATION_SHARE]

    def loss(t):
        total = 0.0
        for i in held:
            logits = [sum(v * weight(f, c) for f, v in rows[i].items()) / t for c in range(3)]
            total -= logits[target[i]] - max(logits) - math.log(sum(math.exp(v - max(logits)) for v in logits))
        return total

    assert min(np.geomspace(0.1, 5.0, 60), key=loss) == pytest.approx(model.temperature)


def test_op8_samples_every_language_and_is_brought_to_true_shares(spark):
    free = [i for i in range(3000) if not _langid_held(i)]
    rows = [(i, "rare words here" if n % 100 == 0 else "common words there", "xx" if n % 100 == 0 else "yy") for n, i in enumerate(free)]
    docs = spark.createDataFrame([*rows, *[rows[1]] * 500], "doc_id long, text string, lang string")
    picked = langid.sample(docs, 60).collect()
    assert sum(x["lang"] == "xx" for x in picked) == sum(x["lang"] == "xx" for x in [r for r in picked]) and len({x["doc_id"] for x in picked}) == len(picked)
    n_rare = sum(r[2] == "xx" for r in rows)
    assert {x["lang"]: x["n"] for x in picked} == {"xx": n_rare, "yy": len(rows) - n_rare}
    assert sum(x["lang"] == "xx" for x in picked) == min(n_rare, langid.LEAST_DOCS) and sum(x["lang"] == "yy" for x in picked) == langid.LEAST_DOCS
    models = [langid.fit(t, sample_docs=60) for t in (docs, docs.repartition(5))]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].temperature == models[1].temperature
    assert models[0].predict(["rare words here", "common words there"])[0] == ["xx", "yy"]


def _langid_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op10_feature_equals_plain_transform():
    r = np.random.default_rng(6)
    for height in (24, 48, 240):
        samples = r.integers(0, 256, (height, 24)).astype(np.uint8)
        square = [[sum(float(samples[y * height // 24 + i, x]) for i in range(height // 24)) / (height // 24) for x in range(24)] for y in range(24)]
        low = [sum(square[y][x] * math.cos(math.pi * (2 * y + 1) * u / 48) * math.cos(math.pi * (2 * x + 1) * v / 48) for y in range(24) for x in range(24)) for u in range(8) for v in range(8)]
        middle = (sorted(low)[31] + sorted(low)[32]) / 2
        assert media.cosine_hash(samples) == f"{int(''.join('1' if c > middle else '0' for c in low), 2):016x}"
    assert media.cosine_hash(np.full((24, 24), 255, np.uint8)) == media.cosine_hash(np.full((48, 24), 255, np.uint8))


def test_op4_takes_clusters_of_near_copies(spark):
    docs = spark.createDataFrame([(1, "a b c", "s1"), (2, "a b d", "s2"), (3, "x y", "s3")], "doc_id long, text string, source string")
    clusters = spark.createDataFrame([(1, 7), (2, 7)], "doc_id long, cluster long")
    together = {r["doc_id"]: r["bin_id"] for r in packing.pack_documents(docs).collect()}
    apart = {r["doc_id"]: r["bin_id"] for r in packing.pack_documents(docs, clusters=clusters).collect()}
    assert len(set(together.values())) == 1 and apart[1] != apart[2] and len(set(apart.values())) == 2
    repeated = spark.createDataFrame([(5, "same text", "s")] * 300, "doc_id long, text string, source string").repartition(3)
    rows = packing.pack(packing.measured(repeated), 64, 10).collect()
    assert len(rows) == 300 and max(sum(r["bin_id"] >> 32 == g for r in rows) for g in {r["bin_id"] >> 32 for r in rows}) < 60


def test_pipeline_on_an_empty_table_and_on_rows_that_all_go(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, TINY)
        assert docs.columns == empty.columns and docs.count() == 0
    assert corpus_pipeline.best_fit(spark, docs, TINY).count() == 0
    silent = spark.createDataFrame([(1, None, "en", "s", 0, 0.0, "b"), (2, "123 !!", "en", "s", 6, 0.0, "b")], SCHEMA)
    assert corpus_pipeline.language(spark, silent, TINY).count() == 0
    bad = quality.Network.fresh()
    bad.weights[:], bad.offset[:] = 0, -9
    kept = quality.keep_good(silent, bad)
    assert kept.count() == 0 and kept.columns == silent.columns


def test_pipeline_stages_on_hostile_rows(spark):
    """Null and empty texts, repeated rows, near copies, null ids and columns whose names clash with the stages' own."""
    tables = spark.read.parquet(f"{TINY}/documents.parquet")
    real = tables.select("doc_id", "text", "lang", "source").limit(60).collect()
    names = ["row", "tie", "id", "no_id", "score", "lang_pred", "held_out", "cluster", "n_tokens", "group"]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], *names) for r in real]
    text = max((r["text"] for r in real), key=len)
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, *names), (900_001, None, None, None, *names), (900_002, "", None, None, *names), (900_003, text + " end", "en", None, *names), (900_004, text * 30, "en", None, *names)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string", *[f"`{n}` string" for n in names]])).repartition(3)
    ids = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, TINY).collect()]
    assert len(ids) == len(set(ids)) and 900_003 not in ids and None not in ids
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, TINY)
        assert kept.columns == docs.columns
    found = {r["doc_id"]: tuple(r) for r in kept.collect()}
    assert found and all(v in set(rows) for v in found.values()) and 900_001 not in found and 900_002 not in found
    placed = corpus_pipeline.best_fit(spark, kept, TINY).collect()
    assert {p["doc_id"] for p in placed} == set(found)


def test_op6_ranges_are_dealt_in_turn(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"))
    placed = minhash.with_next(docs, 50)
    where = {}
    for r in placed.withColumn("part", F.spark_partition_id()).select("part", "range").distinct().collect():
        where.setdefault(r["range"], set()).add(r["part"])
    assert all(len(p) == 1 for p in where.values())
    counts = [sum(p == {k} for p in where.values()) for k in range(parts)]
    assert max(counts) - min(counts) <= 1
