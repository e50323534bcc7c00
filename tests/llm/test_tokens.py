import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import chunk_bpe, token_store, trie_counts
from ledgerloom.llm.tokens import PLAIN, PreTokenEncoder, content_cuts, vocab_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocab_path())


@pytest.fixture(scope="module")
def bpe():
    return PreTokenEncoder(vocab_path(), cache_entries=50)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library, bpe):
    r = random.Random(2)
    alphabet = [chr(c) for c in range(0x250) if PLAIN.fullmatch(chr(c))] + list("  \n\n'’sdmtre²日🙂") + ["<|endoftext|>", "'ll", " the"]
    for _ in range(3000):
        text = "".join(r.choices(alphabet, k=r.randint(0, 25)))
        assert bpe.ids(bpe.encode(text)).tolist() == ids_of(library, text), repr(text)
        assert bpe.decode(bpe.ids(bpe.encode(text))) == library.decode(ids_of(library, text), skip_special_tokens=False)


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_cuts_cover_and_follow_content(dtype):
    r = np.random.default_rng(0)
    values = r.integers(0, 200, 40000).astype(dtype)
    cuts = content_cuts(values, 8, 64, 1024)
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == len(values) and sizes.max() <= 1024 and sizes[:-1].min() >= 64
    moved = content_cuts(np.concatenate([values[:100][::-1], values]).astype(dtype), 8, 64, 1024)
    assert len({c + 100 for c in cuts} & set(moved)) > len(cuts) * 0.8
    assert content_cuts(values[:0], 8, 64, 1024) == []


def test_repaired_joins_equal_whole_text(library, bpe):
    r = random.Random(4)
    pieces = ["the", " of", "  ", "\n", "don't", "x" * 40, " 12", "<|endoftext|>", "größe ", " Wort", "!!", "日本", " a b c d "]
    for _ in range(300):
        raw = "".join(r.choices(pieces, k=r.randint(1, 120))).encode()
        cuts = sorted({c for c in r.choices(range(len(raw) + 1), k=4) if c in (0, len(raw)) or raw[c] & 0xC0 != 0x80} | {0, len(raw)})
        syncs = chunk_bpe.sync_points(raw)
        parts = [chunk_bpe.Segment(bpe, a, b, bpe.ids(bpe.encode(raw[a:b].decode())), syncs) for a, b in zip(cuts, cuts[1:])]
        assert chunk_bpe.repaired(bpe, raw, parts).tolist() == ids_of(library, raw.decode())


def test_op2_equals_library(spark, docs, rows, library):
    encoded = chunk_bpe.encode(docs)
    found = {bytes(r["key"]): r for r in chunk_bpe.digests(encoded).collect()}
    assert sorted(map(str, chunk_bpe.encode_digests(docs).collect())) == sorted(map(str, found.values()))
    back = {bytes(r["key"]): r["text"] for r in chunk_bpe.decode(encoded).collect()}
    for text in {r[1] or "" for r in rows}:
        ids, key = ids_of(library, text), hashlib.sha256(text.encode()).digest()[: chunk_bpe.KEY_BYTES]
        assert found[key]["n_tokens"] == len(ids) and bytes(found[key]["ids_sha256"]) == hashlib.sha256(np.array(ids, "<u4").tobytes()).digest()
        assert back[key] == library.decode(ids, skip_special_tokens=False)
    assert len(found) == len({r[1] or "" for r in rows})


def test_op2_empty(empty):
    assert chunk_bpe.encode(empty).count() == 0


def test_op3_round_trip(spark, docs, rows, library, tmp_path):
    path = token_store.write_store(docs, str(tmp_path / "store"))
    digests = sorted(token_store.read_digests(spark, path).collect(), key=lambda r: r["start"])
    whole = {r["start"]: r for r in token_store.read_store(spark, path).collect()}
    assert len(digests) == len(rows) and [r["doc_id"] for r in digests] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    text, start = {r[0]: r[1] for r in rows}, 0
    for r in digests:
        ids = [*ids_of(library, text[r["doc_id"]]), 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert whole[start]["ids"] == ids
        start += len(ids)
    chunks = spark.read.parquet(f"{path}/parts").filter("kind = 1")
    assert chunks.count() == chunks.select("hash").distinct().count()


def test_op3_empty_and_damage(spark, empty, docs, tmp_path):
    assert token_store.read_digests(spark, token_store.write_store(empty, str(tmp_path / "none"))).count() == 0
    crcs = np.array([zlib.crc32(x) for x in (b"ab", b"cdefg", b"", b"h")])
    assert token_store.crc32_joined(crcs, np.array([2, 5, 0, 1]), np.array([0, 3])).tolist() == [zlib.crc32(b"abcdefg"), zlib.crc32(b"h")]
    path = token_store.write_store(docs, str(tmp_path / "good"))
    spoiled = spark.read.parquet(f"{path}/parts").withColumn("body", F.expr("if(kind = 1, cast(concat(cast(substring(body, 1, length(body) - 2) AS binary), X'FFFF') AS binary), body)"))
    spoiled.write.partitionBy("kind").parquet(str(tmp_path / "bad" / "parts"))
    for part in ("recipes", "manifest", "root"):
        spark.read.parquet(f"{path}/{part}").write.parquet(str(tmp_path / "bad" / part))
    with pytest.raises(Exception, match="does not match its hash"):
        token_store.read_digests(spark, str(tmp_path / "bad")).collect()
    assert token_store.merkle_root([b"a", b"b"]) != token_store.merkle_root([b"b", b"a"]) and token_store.merkle_root([]) != token_store.merkle_root([b""])


@pytest.mark.parametrize("reader", ["read_digests", "read_store"])
def test_op3_manifest_finds_every_loss(spark, docs, tmp_path, reader):
    """A recipe lost, added or renamed, a range lost, a chunk lost or swapped for another, and a changed manifest."""
    path = token_store.write_store(docs, str(tmp_path / "good"))
    recipes, parts, manifest = (spark.read.parquet(f"{path}/{part}") for part in ("recipes", "parts", "manifest"))
    some = recipes.filter("doc_id = 4").first()  # a text of one id and the end id
    only = bytes(some["hashes"])[: token_store.HASH].hex()
    other = parts.filter(f"kind = 1 AND hash <> X'{only}' AND n = {some['n_tokens']}").first()
    changes = {
        "recipe lost": ("recipes", recipes.filter("doc_id IS NULL OR doc_id <> 4"), "manifest"),
        "recipe twice": ("recipes", recipes.unionByName(recipes.filter("doc_id = 4")), "manifest"),
        "id changed": ("recipes", recipes.withColumn("doc_id", F.expr("doc_id + 1000000")), "manifest"),
        "range lost": ("recipes", recipes.filter("range <> 0"), "manifest"),
        "range lost everywhere": ("manifest", manifest.filter("false"), "root"),
        "manifest changed": ("manifest", manifest.withColumn("ids", F.expr("ids + 1")), "root"),
        "chunk lost": ("parts", parts.filter(f"kind = 0 OR hash <> X'{only}'"), "recipe"),
        "chunk swapped": ("parts", parts.withColumn("body", F.expr(f"if(kind = 1 AND hash = X'{only}', X'{bytes(other['body']).hex()}', body)")), "hash|recipe"),
    }
    for name, (what, changed, message) in changes.items():
        bad = str(tmp_path / name.replace(" ", "-"))
        for part in ("recipes", "manifest", "root", "parts"):
            table = changed if part == what else spark.read.parquet(f"{path}/{part}")
            (table.write.partitionBy("kind") if part == "parts" else table.write).parquet(f"{bad}/{part}")
        with pytest.raises(Exception, match=message):
            getattr(token_store, reader)(spark, bad).collect()


def brute_pieces(word: bytes, scores) -> int:
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max((best[a][0] + scores[word[a:end]], best[a][1] - 1) for a in range(end) if word[a:end] in scores))
    return -best[-1][1]


def test_op5_equals_plain_dynamic_programming(docs, rows, empty):
    import public_tokenizers
    import regex

    c = trie_counts.UnigramCounter(vocab_path(), trie_counts.piece_counts(docs).tobytes())
    split = regex.compile(public_tokenizers.PATTERN).findall
    short = {r[0]: r[1] or "" for r in rows if len(r[1] or "") < 5000}
    found = [r for r in trie_counts.count_tokens(docs).collect()]
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] in short:
            words = split(short[r["doc_id"]])
            assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(brute_pieces(w.encode(), c.trie.scores) for w in words))
    assert trie_counts.count_tokens(empty).count() == 0


def test_op5_scores_come_from_the_documents(spark, docs, rows, library):
    counts = trie_counts.piece_counts(docs)
    expected = np.zeros(len(counts), dtype=np.int64)
    for r in rows:
        np.add.at(expected, ids_of(library, r[1] or ""), 1)
    assert np.array_equal(counts, expected)
    scores = trie_counts.unigram_scores([b"x", b"y", b"z", b"<end>"], np.array([8, 0, 2, 99]), frozenset([3]))
    assert scores == pytest.approx({b"x": np.log(9 / 13), b"y": np.log(1 / 13), b"z": np.log(3 / 13)})
    one = spark.createDataFrame([(1, "zebra zebra zebra")], "doc_id long, text string")
    other = spark.createDataFrame([(1, "zebra zebra zebra"), *((2 + i, "z e b r a") for i in range(300))], "doc_id long, text string")
    n = [trie_counts.count_tokens(t).filter("doc_id = 1").first()["n_tokens"] for t in (one, other)]
    assert n[0] <= n[1]


def test_trie_shares_prefixes():
    t = trie_counts.ForwardTrie({b"a": -1.0, b"b": -1.0, b"ab": -1.5, b"c": -1.0})
    assert t.insert(b"abc") == 2 and len(t.best) == 4
    assert t.insert(b"aba") == 2 and len(t.best) == 5
    assert t.insert(b"ab") == 1 and t.insert(b"") == 0 and len(t.best) == 5
