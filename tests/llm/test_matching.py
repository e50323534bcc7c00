import random
import re

import numpy as np
import xxhash

from ledgerloom.llm import license_scan, minhash, simhash

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_op1_equals_search(docs, rows, empty):
    found = license_scan.digest(license_scan.scan(docs)).collect()
    assert len(found) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in found:
        w = words_of(text[r["doc_id"]])
        at, names = [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += hits
            names |= {label} if hits else set()
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted(names)) and names <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert license_scan.digest(license_scan.scan(empty)).count() == 0


def test_op1_equals_its_sql(spark):
    import duckdb

    from ledgerloom.llm.queries import oracle_sql

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    expected = db.sql(f"SELECT {', '.join(names)} FROM ({oracle_sql()['op1_license_scan']}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in license_scan.op1_license_scan(spark, folder).select(*names).orderBy("doc_id").collect()] == expected


def test_op1_filters_lose_no_block():
    r = random.Random(1)
    whole = license_scan.templates()
    vocabulary = sorted({w for t in whole for w in t.words})
    for overlap in sorted({t.overlap for t in whole}):
        made = [t for t in whole if t.overlap == overlap]
        index = license_scan.TemplateIndex(made, {w: r.randint(0, 9) for w in vocabulary})
        for _ in range(150):
            words = [r.choice(vocabulary) if r.random() < 0.5 else b"filler%d" % r.randint(0, 9) for _ in range(r.randint(0, 6 * overlap))]
            if r.random() < 0.7 and words:
                at = r.randint(0, len(words))
                words[at:at] = r.choice(made).words
            brute = set()
            for block in range(max(0, -(-(len(words) - 2 * overlap) // overlap)) + 1):
                held = set(words[block * overlap : block * overlap + 2 * overlap])
                for at, t in enumerate(made):
                    share = len(held & t.distinct) / len(t.distinct)
                    if share >= license_scan.THRESHOLD:
                        brute.add((at, block * overlap, share))
            assert set(index.matches(words, overlap)) == brute


def test_op1_finds_whole_licences_of_any_length(spark):
    assert max(len(t.words) for t in license_scan.templates()) > 100 and len({t.overlap for t in license_scan.templates()}) > 2
    mit = license_scan.LICENSES["mit"].split()
    r = random.Random(8)
    edited = [f"x{i}" if r.random() < 0.08 else w for i, w in enumerate(mit)]
    filler = [f"f{i}" for i in range(333)]
    long = {f"own-{n}": " ".join(f"w{i}" for i in range(n)) for n in (1, 33, 34, 700)}
    rows = [(1, " ".join(filler[:77] + edited + filler[77:])), (2, " ".join(mit[:60])), (3, long["own-700"]), (4, " ".join(filler))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x["doc_id"]: x for x in license_scan.digest(license_scan.scan(docs)).collect()}
    assert found[1]["labels"] == "mit" and 0.8 <= found[1]["score"] <= 1 and found[4]["labels"] == ""
    own = {x["doc_id"]: x["labels"] for x in license_scan.digest(license_scan.scan(docs, license_scan.templates({}, long))).collect()}
    assert own[3] == ",".join(sorted(long)) and own[4] == ""


def plain_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_op9_equals_all_pairs(docs, rows, empty):
    found = {(r["doc_id"], r["fp"] % (1 << 64)): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert simhash.near_duplicates(docs).count() == len(rows)
    fps = [plain_simhash(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        assert found[(r[0], fps[i])] == min(ids, default=None)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_op9_keys_meet_at_every_distance(spark):
    r = random.Random(3)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    pairs = []
    for _ in range(2000):
        a = b = r.getrandbits(64)
        for bit in r.sample(range(64), r.randint(0, 4)):
            b ^= 1 << bit
        pairs.append((signed(a), signed(b)))
    met = spark.createDataFrame(pairs, "a long, b long").select(simhash.variants("a").alias("x"), simhash.variants("b").alias("y")).selectExpr("size(array_distinct(x)) AS n", "arrays_overlap(x, y) AS met").groupBy("n", "met").count().collect()
    assert [(x["n"], x["met"], x["count"]) for x in met] == [(183, True, 2000)]


def test_op9_chain_of_near_copies(spark):
    """A long chain and a dense group: components, not only direct links."""
    r, chain = random.Random(9), []
    fp = r.getrandbits(63)
    for i in range(40):
        chain.append((100 + i, i, fp))
        for bit in r.sample(range(63), 4):
            fp ^= 1 << bit
    centre = r.getrandbits(63)
    dense = [(1000 + i, i, centre ^ (1 << i % 63) ^ (1 << (i * 7 + 3) % 63)) for i in range(120)]
    signed = spark.createDataFrame(chain + dense, "doc_id long, tie long, fp long")
    named = signed.join(simhash.classes(signed), "fp").groupBy("root").agg({"doc_id": "min", "fp": "count"}).collect()
    assert sorted(x["count(fp)"] for x in named) == [40, 120]


def test_joined_near_copies_leave_the_index(spark, monkeypatch):
    """A large group of near copies gives rows in the whole index only where a key still holds different components."""
    r, written = random.Random(4), []
    centre = min(r.getrandbits(62) for _ in range(50)) & ~((1 << 8) - 1)
    copies = [centre] + [centre | 1 << a | 1 << b for a in range(8) for b in range(a)]
    others = [r.getrandbits(63) for _ in range(100)]
    signed = spark.createDataFrame([(i, i, fp) for i, fp in enumerate(copies + others)], "doc_id long, tie long, fp long")
    write = simhash.Scratch.write

    def noted(scratch, df, small=False):
        made = write(scratch, df, small)
        written.append(made.count() if "centre" in made.columns and "fp" in made.columns else 0)
        return made

    monkeypatch.setattr(simhash.Scratch, "write", noted)
    found = {x["fp"]: x["root"] for x in simhash.classes(signed).collect()}
    assert {found[fp] for fp in copies} == {min(copies)} and all(found[fp] == fp for fp in others)
    # the 15 keys of equal segments join all copies, so the others hold none of them
    assert 0 < sum(written) <= 15 * len(copies)


def test_components_of_many_tasks_equal_one(spark):
    """Links beyond what one task contracts: a long path, a star, a clique and stray pairs, in any number of tasks."""
    r = random.Random(2)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 80)] + [(2000 + i, 2000 + j) for i in range(12) for j in range(i)] + [(3000 + 2 * i, 3001 + 2 * i) for i in range(40)] + [(7, 7)]
    r.shuffle(links)
    edges = spark.createDataFrame([pair if r.random() < 0.5 else pair[::-1] for pair in links], "a long, b long").repartition(7)
    expected = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(80)} | {2000 + i: 2000 for i in range(12)} | {3000 + 2 * i + k: 3000 + 2 * i for i in range(40) for k in (0, 1)}
    for bound in (250_000, 100):
        found = [(x["node"], x["root"]) for x in simhash.connected_components(edges, bound).collect()]
        assert len(found) == len(set(found)) and dict(found) == expected


def test_keep_one_keeps_columns_and_clean_rows(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids))


def test_keep_one_with_clashing_names(spark):
    names = ["row", "tie", "id", "no_id", "number", "stay_id", "stay_tie", "__tie", "__row", "root", "node"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(["a b c d e f", "a b c d e f", None, "", "other words stand here now"])]
    docs = spark.createDataFrame([*rows, rows[4]], ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2], rows[4]]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_op6_contract(spark, empty):
    r = random.Random(7)
    base = [f"w{i}" for i in range(3000)]
    data = [(i * 3, None if i == 4 else " ".join(r.choices(base, k=r.choice([0, 2, 40, 400, 900]))) + ("é" * (i % 3))) for i in range(60)]
    data.append((data[5][0] + 1, data[5][1]))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    found = {x["doc_id"]: x for x in minhash.edited_pairs(df).collect()}
    small = {x["doc_id"]: x for x in minhash.edited_pairs(df.repartition(2)).collect()}
    by_range = {x["doc_id"]: x for x in minhash.with_next(df.selectExpr("doc_id", "coalesce(text, '') AS text"), 7).filter("NOT extra").collect()}
    order = sorted(data)
    errors = []
    for at, (i, text) in enumerate(order):
        text, follower = text or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        x = found[i]
        assert x == small[i] and by_range[i]["next_text"] == follower
        assert x["n_chars"] == len(text) and x["edited_sha256"] == __import__("hashlib").sha256(edited.encode()).hexdigest()
        for value, other in ((x["near_edited"], edited), (x["near_next"], follower)):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert 0 <= value <= 1
            errors.append(value - true)
    assert found[data[5][0]]["fingerprint"] == found[data[5][0] + 1]["fingerprint"]
    assert np.sqrt(np.mean(np.square(errors))) < 0.06 and abs(np.mean(errors)) < 0.02
    assert minhash.edited_pairs(empty).count() == 0


def test_op6_edge_rows(docs, rows):
    assert minhash.edited_pairs(docs).count() == len(rows) and minhash.fingerprints(docs).count() == len(rows)


def test_variant_groups_hold_both_values_of_their_bit(spark, monkeypatch):
    """A crowded neighbourhood of fingerprints: all pairs' components, from groups that only a wildcard bit can still join."""
    r, written = random.Random(6), []
    base = r.getrandbits(63)
    fps = {base}
    while len(fps) < 160:
        fp = base
        for bit in r.sample(range(63), r.randint(1, 7)):
            fp ^= 1 << bit
        fps.add(fp)
    fps = sorted(fps)
    # no segment of these two is equal: they meet by a wildcard only, in a group of two
    fps += [1 << 62, (1 << 62) ^ 1 ^ (1 << 21) ^ (3 << 50)]
    root = {fp: fp for fp in fps}
    for _ in fps:
        for a in fps:
            root[a] = min(root[b] for b in fps if (a ^ b).bit_count() <= 4)
    write = simhash.Scratch.write

    def noted(scratch, df, small=False):
        made = write(scratch, df, small)
        if "centre" in made.columns and "fp" in made.columns:
            written.append(made.select("key", "fp").collect())
        return made

    monkeypatch.setattr(simhash.Scratch, "write", noted)
    found = spark.createDataFrame([(i, i, fp) for i, fp in enumerate(fps)], "doc_id long, tie long, fp long")
    assert {x["fp"]: x["root"] for x in simhash.classes(found).collect()} == root and len(set(root.values())) > 10
    wildcards = [b for lowest, width in simhash.SEGMENTS[:2] for b in range(lowest, lowest + width)]
    plain = lambda key: key >> 40 < 5 or key >> 40 >= 178 or 89 <= key >> 40 < 94
    groups = {}
    for key, fp in (x for rows in written for x in rows if not plain(x["key"])):
        groups.setdefault(key, []).append(fp)
    assert groups
    for key, held in groups.items():
        at = (key >> 40) - (5 if key >> 40 < 89 else 10)
        assert len(held) > 2 and {fp >> wildcards[at // 4] & 1 for fp in held} == {0, 1}


def test_components_take_every_star_round_at_the_default_bound(spark, monkeypatch):
    """Few links go through the same large and small stars as many: each written table equals a plain loop's."""
    links = {(i + 1, i) for i in range(20)} | {(50, 40), (50, 41), (60, 50), (61, 60)}

    def neighbours(pairs):
        near = {}
        for a, b in pairs:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        return near

    expected, before, at = [], None, links
    while at != before:
        before = at
        large = {(v, min(u, *near)) for u, near in neighbours(at).items() for v in near if v > u}
        lower = {u: {v for v in near if v < u} for u, near in neighbours(large).items()}
        at = {(v, min(low)) for u, low in lower.items() if low for v in low | {u} if v != min(low)}
        expected += [large, at]
    write, written = simhash.Scratch.write, []

    def noted(scratch, df, small=False):
        made = write(scratch, df, small)
        if made.columns == ["a", "b"]:
            written.append({tuple(x) for x in made.collect()})
        return made

    monkeypatch.setattr(simhash.Scratch, "write", noted)
    edges = spark.createDataFrame(sorted(links), "a long, b long").repartition(3)
    found = {(x["node"], x["root"]) for x in simhash.connected_components(edges).collect()}
    assert found == {(i, 0) for i in range(21)} | {(i, 40) for i in (40, 41, 50, 60, 61)}
    # the loop's last round changes nothing
    assert written == [links, *expected[:-2]] and len(written) > 5
