import zlib

import numpy as np
import pytest

from ledgerloom.llm import langid, media, packing, quality
from ledgerloom.llm.tokens import vocab_path  # noqa: F401

from .conftest import TINY

SF = "/root/testdata/sf0.01"


def test_op4_packs_everything_without_conflicts(docs, rows, empty):
    lengths = packing.measured(docs)
    placed = packing.pack(lengths, capacity=512, group_rows=10).collect()
    bins = {}
    for p in placed:
        bins.setdefault(p["bin_id"], []).append(p)
    assert sum(p["n_tokens"] for p in placed) == sum(r["n_tokens"] for r in lengths.collect())
    for inside in bins.values():
        inside.sort(key=lambda p: p["bin_offset"])
        ends = [p["bin_offset"] + p["n_tokens"] for p in inside]
        assert ends[-1] <= 512 and all(e == p["bin_offset"] for e, p in zip(ends, inside[1:]))
        for column in ("source", "cluster"):
            values = [p[column] for p in inside if p[column] is not None]
            assert len(values) == len(set(values))
    assert packing.pack_documents(empty).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    r = np.random.default_rng(3)
    for _ in range(50):
        items = [(int(r.integers(1, 60)), int(1 << r.integers(0, 4)) if r.random() < 0.7 else 0, int(1 << r.integers(0, 6)) if r.random() < 0.5 else 0) for _ in range(60)]
        placed, bins = packing.best_fit(items, 100), []
        expected = [None] * len(items)
        for at in sorted(range(len(items)), key=lambda i: -items[i][0]):
            n, s, c = items[at]
            fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= n and not b[1] & s and not b[2] & c]
            k = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append([100, 0, 0])
            expected[at] = (k, 100 - bins[k][0])
            bins[k] = [bins[k][0] - n, bins[k][1] | s, bins[k][2] | c]
        assert placed == expected


def test_op7_gradient():
    r = np.random.default_rng(1)
    net = quality.Network(*[p.astype(np.float64) for p in quality.Network.fresh(2).parameters()])
    chunks, sizes = r.integers(0, 256, (5, quality.CHUNK)).astype(np.uint8), np.array([2, 3])
    starts, y, w = np.array([0, 2]), np.array([1.0, 0.0]), np.array([1.0, 0.5])
    _, found = quality.gradients(net, chunks, starts, sizes, y, w)
    for p, g in zip(net.parameters(), found):
        for at in [np.unravel_index(k, p.shape) for k in np.argsort(-np.abs(g), axis=None)[:2]]:
            before, step = p[at], 1e-6
            p[at] = before + step
            up = quality.gradients(net, chunks, starts, sizes, y, w)[0]
            p[at] = before - step
            down = quality.gradients(net, chunks, starts, sizes, y, w)[0]
            p[at] = before
            assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=2e-2, abs=1e-5)


def test_op7_reads_whole_texts():
    net = quality.Network.fresh(0)
    text = "a" * 5000
    covered = quality.chunks_of(text)
    assert covered.shape[0] * (quality.CHUNK - quality.OVERLAP) + quality.OVERLAP >= 5000
    assert quality.chunks_of("").shape == (1, quality.CHUNK)
    assert net.scores([text])[0] != net.scores([text + " *** !! |"])[0]
    many = ["x y z " * n for n in (1, 50, 2000)]
    assert np.allclose(net.scores(many), [net.scores([t])[0] for t in many], atol=1e-6)


def test_op7_held_out_accuracy(spark):
    df = quality.op7_quality(spark, SF)
    y = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = df.collect()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    held = [(r["predicted"], y[r["doc_id"]]) for r in out if r["held_out"] and y.get(r["doc_id"]) is not None]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_op7_edges(docs, rows, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (3, 0, 1), (3, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(docs, labels)
    assert quality.score(docs, net).count() == len(rows) and quality.score(empty, net).count() == 0
    none = quality.fit(docs, labels.filter("false"))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


def test_op8_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = langid.op8_langid(spark, SF).collect()
    assert len(out) == len(lang)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in out if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean(held) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)


def test_op8_edges(docs, rows, empty):
    model = langid.fit(docs)
    found = langid.predict(docs, model).collect()
    text = {r[0]: r[1] for r in rows}
    assert len(found) == len(rows)
    for r in found:
        blank = not any(c.isalpha() for c in text[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == blank
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}
    assert langid.keep_readable(docs, model, least=0.0).columns == docs.columns


def test_op8_frequencies_count_documents(docs, rows):
    frequencies, n = langid.document_frequencies(docs)
    assert n == len(rows)
    seen = np.zeros(langid.SIZE)
    for r in rows:
        own = np.concatenate([f[s[0] : e[0]] for f, s, e in langid.ngram_features([r[1] or ""])])
        seen[np.unique(own)] += 1
    assert np.array_equal(seen, frequencies)


def test_op10_round_trip(docs, rows, empty):
    found = media.features(media.encode(docs)).collect()
    text = {r[0]: r[1] for r in rows}
    assert len(found) == len(rows)
    for r in found:
        payload = media.payload_of(text[r["doc_id"]] or "")
        assert len(payload) % 576 == 0 and len(payload) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == __import__("hashlib").sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
    assert media.features(media.encode(empty)).count() == 0


def test_png_filters_and_damage():
    r = np.random.default_rng(0)
    samples = r.integers(0, 256, (48, 24)).astype(np.uint8)
    for kind in (None, 0, 1, 2):
        assert np.array_equal(media.read_png(media.write_png(samples, kind)), samples)
    above = np.vstack([np.zeros((1, 24), np.uint8), samples[:-1]]).astype(int)
    left = np.hstack([np.zeros((48, 1), np.uint8), samples[:, :-1]]).astype(int)
    corner = np.hstack([np.zeros((48, 1), int), above[:, :-1]])
    p = left + above - corner
    near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
    guesses = {0: np.zeros((48, 24), int), 1: left, 2: above, 3: (left + above) // 2, 4: near}
    kinds = r.integers(0, 5, 48)
    rows = np.array([np.concatenate([[k], (samples[y] - guesses[k][y]) % 256]) for y, k in enumerate(kinds)]).astype(np.uint8)
    assert np.array_equal(media.unfilter(rows), samples)
    stored = bytearray(media.write_png(samples))
    stored[60] ^= 1
    with pytest.raises(ValueError):
        media.read_png(bytes(stored))


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "best_fit"]
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    kept, before = docs, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, TINY)
        assert kept.columns == docs.columns and 0 < kept.count() <= before
    placed = corpus_pipeline.run(spark, TINY)
    assert placed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
