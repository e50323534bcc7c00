"""Record contracts, model selection, planting, keys and file ends on small tables."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import hashing
from ledgerloom.operators import audit, profiles, records, selection
from ledgerloom.sources import tables

NOW = datetime(2024, 1, 2, 3)
BAND = (0.1, 0.4, 5, "reliable")
EVIDENCE = ("e1", "tool", "c1", NOW, "claim", "{}", "text")
BUDGET = (1, 1, 10, 10, 0.0)
SPEAKER = ("name", "r", ["e1"], "close", "why", "note", BUDGET)
CALL = ("c1", "r", "tool", "1", NOW, "{}", "h", None, 1.0, "ok", None)
#: One good row of every kind, and rows that break what is named.
ROWS = {
    "alert": (("A1", "1|2", NOW, NOW, datetime(2024, 1, 3), ["R01"], '{"n": 1}', NOW), [({1: "12"}, "composite key"), ({5: []}, "one rule at least"), ({4: NOW}, "window closed"), ({6: '{"a": [{"Is-Laundering": 1}]}'}, "open keys"), ({0: None}, "alert_id is given")]),
    "calibration_band": (BAND, [({0: 0.5}, "bounds in order"), ({1: 1.5}, "bounds are shares"), ({2: -1}, "support"), ({3: "sure"}, "flag")]),
    "feature_contribution": (("f", None, 0.1), [({0: None}, "name is given")]),
    "score_result": (("A1", "m", "h", "c", 0.2, 1.0, BAND, [("f", "1", 0.1)], "log-odds"), [({4: 0.5}, "inside its band"), ({6: (0.3, 0.1, 1, "reliable")}, "calibration_band: bounds in order"), ({6: (0.1, 0.4, 1, "sure")}, "calibration_band: flag")]),
    "evidence_item": (EVIDENCE, [({5: '{"x": {" Attempt ID ": 3}}'}, "open keys")]),
    "budget_used": (BUDGET, [({1: -1}, "no negative use")]),
    "agent_output": (SPEAKER, [({6: (1, 1, -1, 1, 0.0)}, "budget_used: no negative use")]),
    "deliberation": ((SPEAKER, None, None, ["defence"]), [({3: ["judge"]}, "known sides")]),
    "citation": (("k", "e1", None), [({2: "s"}, "exactly one source"), ({1: None}, "exactly one source")]),
    "policy_step": (("done", "e1"), [({1: None}, "done needs evidence"), ({0: "maybe"}, "status")]),
    "case_file": (("A1", "close", [EVIDENCE], (SPEAKER, None, None, []), "text", [("k", "e1", None)], {"s": ("done", "e1")}, None, "ref"), [({5: [("k", "e9", None)]}, "citations resolve"), ({6: {"s": ("done", "e9")}}, "steps resolve"), ({2: []}, "citations resolve"), ({1: "open"}, "recommendation"), ({6: {"s": ("done", None)}}, "steps")]),
    "tool_call": (CALL, [({8: -1.0}, "duration"), ({9: "lost"}, "status")]),
    "trajectory_record": (("r", "c", "agent", None, None, None, None, "{}", None, [CALL], 0, 0, 0.0, 0.0, None, NOW), [({10: -1}, "no negative use"), ({15: None}, "ts is given")]),
    "graph_query": (("1|2", NOW, 24.0, 3), [({2: 0.0}, "lookback"), ({3: 4}, "hops")]),
    "historical_disposition": (("A1", "1|2", "closed_legitimate", NOW), [({2: "closed"}, "disposition")]),
    "decision_record": (("k", "escalate", "reliable", ["e1"], "r", None, None, None), [({5: "escalate"}, "a decision has a reason and an instant"), ({5: "guess", 6: "w", 7: NOW}, "decision")]),
    "run_manifest": (("r", "h", {}, {}, {}, 0.0, None, {"s": 1}, "h", None, None, None, None, None, {}, "c", False, "1", NOW), [({0: None}, "run_id is given")]),
}


def test_every_kind_of_record_is_covered():
    assert set(ROWS) == set(records.RECORDS)


@pytest.mark.parametrize("kind", sorted(ROWS))
def test_record_contract(spark, kind):
    good, bad = ROWS[kind]
    rows = [good, *[tuple(change.get(i, v) for i, v in enumerate(good)) for change, _ in bad]]
    found = []
    for row in rows:
        df = spark.createDataFrame([row], records.schema_of(kind))
        found.append([n for r in records.broken_records(df, kind).collect() for n in r["broken"]])
    assert found[0] == []
    for names, (_, expected) in zip(found[1:], bad):
        assert expected in names
    with pytest.raises(ValueError):
        records.broken_records(spark.createDataFrame([good], records.schema_of(kind)).withColumn("extra", F.lit(1)), kind)


def scored(spark, n=300, seed=0):
    r = np.random.default_rng(seed)
    y = r.random(n) < 0.3
    return spark.createDataFrame([(f"k{i:04d}", f"f{i % 2}", int(v), float(a + v), float(b)) for i, (v, a, b) in enumerate(zip(y, r.normal(size=n), r.normal(size=n)))], "key string, fold string, y int, good double, noise double")


def brute_auc(rows, column):
    pos, neg = [r[column] for r in rows if r["y"]], [r[column] for r in rows if not r["y"]]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)), len(pos)


def test_paired_gain_and_verdicts(spark):
    rows = scored(spark)
    gains = selection.paired_gain(rows, "good", "noise", "fold", "key", replicates=60)
    collected, per = rows.collect(), {}
    for c in ("good", "noise"):
        folds = [brute_auc([r for r in collected if r["fold"] == f], c) for f in ("f0", "f1")]
        per[c] = sum(v * p for v, p in folds) / sum(p for _, p in folds)
    found = selection.comparison(rows, gains, 0.05, 20)
    assert found["gain"] == pytest.approx(per["good"] - per["noise"])
    assert found["verdict"] == "signal" and found["low"] < found["gain"] < found["high"]
    assert selection.comparison(rows, gains, 0.05, 1000)["verdict"] == "insufficient_data"
    assert [selection.gain_verdict(*x) for x in ((0.1, 0.2, 0.1), (0.0, 0.05, 0.1), (0.0, 0.1, 0.1), (None, None, 0.1))] == ["signal", "no_signal", "inconclusive", "insufficient_data"]
    with pytest.raises(ValueError):
        selection.paired_gain(rows, "good", "noise", "fold", "key", most_rows=10)


def test_ceilings(spark):
    rows = scored(spark)
    found = {r["check"]: r for r in selection.ceilings(rows, {"alone": ("noise", None, 2.0), "more": ("good", "noise", 0.1)}, "key", 50).collect()}
    assert found["alone"]["passes"] and not found["more"]["passes"]
    assert all(r["low"] <= r["value"] <= r["high"] for r in found.values())
    assert selection.ceilings(rows, {"alone": ("noise", None, 2.0)}, "key", 5, least_positive=1000).count() == 0


def test_ceilings_of_more_rows_than_a_task_may_hold(spark):
    """Rows drawn where they are give the same values, and intervals of the same law, as rows that travel."""
    rows = scored(spark, 3000).withColumn("noise", F.round("noise", 0)).repartition(3)
    checks = {"alone": ("noise", None, 2.0), "more": ("good", "noise", 0.1)}
    held, spread = ({r["check"]: r for r in selection.ceilings(rows, checks, "key", 400, most_rows=n).collect()} for n in (3000, 2999))
    assert set(held) == set(spread) == set(checks)
    for c in checks:
        assert (spread[c]["value"], spread[c]["ceiling"]) == pytest.approx((held[c]["value"], held[c]["ceiling"])) and spread[c]["passes"] == held[c]["passes"]
        width = held[c]["high"] - held[c]["low"]
        assert abs(spread[c]["low"] - held[c]["low"]) < 0.15 * width and abs(spread[c]["high"] - held[c]["high"]) < 0.15 * width


def test_average_precision_by_ranges_equals_all_rows_at_once(spark):
    from ledgerloom.operators import metrics

    rows = scored(spark, 2000).withColumn("noise", F.round("noise", 0))
    found = {(r["score"], r["replicate"]): r["ap"] for r in metrics.spread_ap(rows, "key", ["good", "noise"], 5, seed=3, range_rows=100).collect()}
    data = rows.withColumn("h", F.xxhash64("key", F.lit(3))).toPandas()
    hashes, draws = data["h"].to_numpy().view(np.uint64), []
    for r in range(-1, 5):
        draws.append(metrics.poisson_draw(hashes, r, 3))
        for c in ("good", "noise"):
            assert found[c, r] == pytest.approx(metrics.tied_auc_ap(data[c].to_numpy(), data["y"].to_numpy().astype(float), draws[-1])[1])
    assert len(found) == 12 and all((a != b).any() for a, b in zip(draws, draws[1:]))
    many = metrics.poisson_draw(hashes.repeat(50) ^ np.arange(100_000, dtype=np.uint64), 0)
    assert abs(many.mean() - 1) < 0.02 and abs(many.var() - 1) < 0.04


def test_category_codes(spark):
    fit = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "z"), (3, None)], "i int, c string")
    found = {r["i"]: r["code_c"] for r in selection.category_codes(fit, rows, ["c"]).collect()}
    assert (found[0], found[1]) == (0.0, 1.0) and math.isnan(found[2]) and math.isnan(found[3])
    assert all(math.isnan(r["code_c"]) for r in selection.category_codes(fit.filter("false"), rows, ["c"]).collect())
    with pytest.raises(ValueError):
        selection.category_codes(fit, rows, ["c"], most=1)


def test_search_and_selection():
    space = selection.search_space({"count": {}, "logistic": {"C": [1, 2], "weight": ["none", "balanced"]}})
    assert [c["id"] for c in space] == ["count", "logistic_C=1_weight=none", "logistic_C=1_weight=balanced", "logistic_C=2_weight=none", "logistic_C=2_weight=balanced"]
    with pytest.raises(ValueError):
        selection.search_space({"logistic": {"C": [1, 1]}})
    order, ap = ["a", "b", "c"], {"a": 0.1, "b": 0.3, "c": 0.3}
    assert selection.simplest_wins(order, ap, {"b": -0.1, "c": None}) == "a"
    assert selection.simplest_wins(order, ap, {"b": 0.1, "c": 0.1}) == "b"


def test_importance_and_learning_curve(spark):
    rows = scored(spark, 200)
    drops = {r["feature"]: r["mean_drop"] for r in selection.permutation_importance(rows, ["good", "noise"], lambda t: t.withColumn("score", F.col("good")), "key", 2).collect()}
    assert drops["good"] > 0.05 and drops["noise"] == 0.0
    curve = selection.learning_curve(rows, rows, [0.0, 0.5, 1.0], "key", lambda part: lambda t: t.withColumn("score", F.col("good"))).collect()
    assert curve[0]["ap_fit"] is None and curve[0]["n_fit"] == 0 and curve[2]["n_fit"] == 200 and curve[1]["n_fit"] < 200
    assert curve[2]["ap_fit"] == curve[2]["ap_check"] == curve[1]["ap_check"]


def test_planting_and_lift(spark):
    alerts = spark.createDataFrame([("1", "a", ["R1", "R2"]), ("2", "a", ["R1"]), ("3", "b", ["R1"]), ("4", "c", [])], "alert_id string, account_key string, triggered_rules array<string>")
    truth = spark.createDataFrame([("1", False), ("2", True), ("3", False), ("4", False)], "alert_id string, is_true_positive boolean")
    planting = spark.createDataFrame([("a", True, "R2"), ("b", True, "R9"), ("z", True, "R1")], "account_key string, planted boolean, dominant_behaviour string")
    found = {r[0]: r[1:] for r in profiles.planting_realisation(alerts, truth, planting).collect()}
    assert found == {True: (1, 1.0, 1.0), False: (2, 0.5, 0.0)}
    accounts = spark.createDataFrame([(k, k < "c") for k in "abcd"], "account_key string, early boolean")
    later = spark.createDataFrame([("a", False), ("c", True), ("d", False)], "account_key string, is_true_positive boolean")
    r = profiles.alert_lift(accounts, spark.createDataFrame([("d",)], "account_key string"), later, ["early"]).first()
    assert (r["n_accounts"], r["alerted_rate_with"], r["alerted_rate_without"], r["alerted_lift"], r["true_lift"]) == (3, 0.5, 1.0, 0.5, 0.0)


def test_footprint(spark):
    df = spark.createDataFrame([(1, "aa", 1.0), (2, "aa", 2.0), (3, None, 3.0)], "i int, s string, d double")
    r = audit.footprint(df).first()
    assert (r["n_rows"], r["string_bytes"], r["dictionary_bytes"]) == (3, 36 + 24 + 4, 36 + 12 + (2 + 8) + 8)
    assert audit.footprint(df.filter("false")).first()["n_rows"] == 0
    assert audit.footprint(df.select("i")).first()["string_bytes"] == 12


def test_group_key():
    secret = "0f" * 32
    key, record = hashing.group_key("GROUP_KEY", environ={"GROUP_KEY": secret})
    assert key == secret and secret not in str(record) and record["source"] == "environment"
    assert hashing.group_key(public="open")[0] == "open"
    for bad in ({}, {"GROUP_KEY": "0F" * 32}, {"GROUP_KEY": secret[:-1]}):
        with pytest.raises(ValueError):
            hashing.group_key("GROUP_KEY", environ=bad)
    with pytest.raises(ValueError):
        hashing.group_key()


def test_head_tail(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"a\r\nb\nc\n\nd\n\n")
    found = [(r["part"], r["line"]) for r in tables.head_tail(spark, str(tmp_path / "f.txt"), 2, 2).collect()]
    assert found == [("head", "a"), ("head", "b"), ("tail", "c"), ("tail", "d")]
