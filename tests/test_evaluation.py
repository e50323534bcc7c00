"""Guards, probes and audits around the alerts, on small hand-made tables."""

import ast
import glob
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from ledgerloom.operators import contracts, evaluation, metrics, models, selection, stats

from .conftest import ROOT


def test_guard_verdicts_in_order():
    up, down, open_ = (0.1, 0.5), (-0.5, -0.1), (-0.2, 0.2)
    cases = [(up, down, down, "harms_unseen"), (up, open_, down, "account_recognition"), (up, up, open_, "pass"), (open_, up, down, "pass"), (up, open_, open_, "inconclusive"), (open_, open_, down, "no_material_gain")]
    for seen, unseen, contrast, verdict in cases:
        assert evaluation.guard_verdict(seen, unseen, contrast) == verdict
    assert set(evaluation.CLEARED) == {"pass", "no_material_gain"}


def guarded(spark, seen_gain, unseen_gain, seed=1, n=500):
    """Two folds; the score separates the classes by a shift that depends on whether the account was seen."""
    r, rows = np.random.default_rng(seed), []
    for fold in ("f1", "f2"):
        for i in range(n):
            y, seen = int(r.random() < 0.25), bool(i % 2)
            base = float(r.normal(0.5 * y))
            rows.append((fold, f"a{i}", y, seen, base, base + (seen_gain if seen else unseen_gain) * y))
    return spark.createDataFrame(rows, "fold string, account_key string, y int, seen boolean, base double, score double")


def test_identity_guard_separates_recognition_from_signal(spark):
    for gains, verdict in (((1.5, 0.0), "account_recognition"), ((1.0, 1.0), "pass"), ((0.0, -1.0), "harms_unseen"), ((0.0, 0.0), "no_material_gain")):
        found = evaluation.identity_guard(guarded(spark, *gains), "base", "score", replicates=200)
        assert found["verdict"] == verdict and found["cleared"] == (verdict in evaluation.CLEARED)
        assert found["seen"]["gain"] == pytest.approx(gains[0], abs=0.25) and found["unseen"]["gain"] == pytest.approx(gains[1], abs=0.35)
    few = evaluation.identity_guard(guarded(spark, 1.0, 1.0, n=60), "base", "score", replicates=20)
    assert few["verdict"] == "insufficient_data" and not few["cleared"]
    twice = guarded(spark, 0.0, 0.0, n=40)
    with pytest.raises(ValueError, match="twice"):
        evaluation.identity_guard(twice.unionByName(twice.limit(1)), "base", "score")


def test_recognition_verdicts():
    v = evaluation.recognition_verdict
    assert v(None, 0.7, (0.6, 0.8), 0.9, 0.6) == "insufficient_data"
    assert v((0.1, 0.2), 0.65, (0.6, 0.7), 0.9, 0.6, (0.55, 0.95)) == "no_gap"
    assert v((0.1, 0.2), 0.65, (0.6, 0.7), 0.9, 0.6, (0.85, 0.95)) == "recognition"
    assert v((-0.01, 0.02), 0.88, (0.8, 0.9), 0.9, 0.6, (0.85, 0.95)) == "population"
    assert v((0.01, 0.2), 0.85, (0.5, 0.9), 0.9, 0.6, (0.85, 0.95)) == "mixed"


def test_recognition_arms_remove_as_many_of_each_class(spark):
    r = random.Random(1)
    fit = spark.createDataFrame([(f"a{i % 40}", i, int(r.random() < 0.4)) for i in range(200)], "account_key string, day int, y int")
    check = spark.createDataFrame([(f"a{i}",) for i in range(10)] + [("new",)], "account_key string")
    arms = {k: [tuple(x) for x in v.collect()] for k, v in evaluation.recognition_arms(fit, check).items()}
    known = {f"a{i}" for i in range(10)}
    assert len(arms["full"]) == 200 and not any(a in known for a, _, _ in arms["disjoint"]) and len(arms["disjoint"]) == 150
    for y in (0, 1):
        assert sum(x[2] == y for x in arms["control"]) == sum(x[2] == y for x in arms["disjoint"])
    assert sum(a in known for a, _, _ in arms["control"]) == 50  # others had rows enough
    short = {k: v.count() for k, v in evaluation.recognition_arms(fit.filter("account_key IN ('a0', 'a1', 'a20')"), check).items()}
    assert short["full"] == 15 and short["control"] == short["disjoint"] == 5


def test_recognition_probe_sees_memory(spark):
    """Scores that are the account's own mean label: perfect on seen accounts, gone without their rows."""
    rows = [(f"a{i}", d, int(i % 5 == 0)) for i in range(60) for d in range(3)]
    fit = spark.createDataFrame(rows, "account_key string, day int, y int")
    check = spark.createDataFrame([(f"a{i}", 9, int(i % 5 == 0)) for i in range(30)] + [(f"b{i}", 9, int(i % 4 == 0)) for i in range(20)], "account_key string, day int, y int")

    def build(part):
        from pyspark.sql import functions as F

        means = part.groupBy("account_key").agg(F.avg("y").alias("m"))
        return lambda t: t.join(means, "account_key", "left").withColumn("score", F.coalesce("m", F.lit(0.2))).drop("m")

    found = {r["arm"]: r for r in evaluation.recognition_probe([("f", fit, check)], build).collect()}
    assert found["full"]["auc_seen"] == found["label_memory"]["auc_seen"] == 1.0 and found["disjoint"]["auc_seen"] == 0.5 and found["full"]["auc_unseen"] == 0.5
    assert (found["full"]["n_fit"], found["disjoint"]["n_fit"], found["control"]["n_fit"]) == (180, 90, 90)
    assert (found["full"]["n_pos_seen"], found["full"]["n_pos_unseen"]) == (6, 5)


def test_embargo_feasibility_and_capacity():
    evaluation.check_embargo([("f", "2024-01-05", "2024-01-07", "2024-01-09")], 2)
    for bad in (("f", "2024-01-06", "2024-01-07", "2024-01-09"), ("f", "2024-01-01", "2024-01-09", "2024-01-09")):
        with pytest.raises(ValueError, match="fold f"):
            evaluation.check_embargo([bad], 2)
    assert evaluation.feasibility({"a": 5, "b": 1}, {"a": 5, "b": 2}) == {"a": True, "b": False}
    with pytest.raises(KeyError):
        evaluation.feasibility({"a": 5}, {"c": 1})
    designs = [("whole", 1000), ("half", 500), ("tiny", 10)]
    assert evaluation.plan_capacity(10, 10_000, 10.0, designs, 0.2) == ("half", 500)
    assert evaluation.plan_capacity(1, 10_000, 1.0, designs, 0.0) == ("whole", 1000)  # a minute's bound: 1440 a day
    with pytest.raises(ValueError):
        evaluation.plan_capacity(1, 5, 10.0, designs, 0.0)


def test_registry(spark):
    f = [evaluation.Feature("x", "g", "sum", ("ts",)), evaluation.Feature("y", "g", "max", ("ts",), 48)]
    assert evaluation.registry_hash(f) != evaluation.registry_hash(f[::-1]) and len(evaluation.registry_hash(f)) == 64
    with pytest.raises(ValueError):
        evaluation.registry_hash([f[0], f[0]])
    evaluation.check_registry(spark.createDataFrame([(1, 2.0, 3.0)], "k int, x double, y double"), f, ["k"])
    with pytest.raises(ValueError):
        evaluation.check_registry(spark.createDataFrame([(1, 2.0, 3.0)], "k int, y double, x double"), f, ["k"])


def test_disposition_audit_known_answers(spark):
    made = datetime(2024, 1, 1)
    rows = [(True, "confirmed_suspicious", 1, 60), (True, "closed_legitimate", 1, 120), (False, "confirmed_suspicious", 2, 30), (False, "closed_legitimate", 2, 90), (False, "closed_legitimate", 1, 600)]
    df = spark.createDataFrame([(t, d, n, made, made + timedelta(minutes=m)) for t, d, n, m in rows], "is_true_positive boolean, disposition string, n_rules_triggered int, created_at timestamp_ntz, closed_at timestamp_ntz")
    found = {r["group"]: r for r in evaluation.disposition_audit(df).collect()}
    assert set(found) == {"all", "true", "false", "rules_1", "rules_2"}
    a = found["all"]
    assert (a["n"], a["accuracy"], a["miss_rate"], a["false_alarm_rate"], a["confirmed_precision"], a["median_minutes"]) == (5, 0.6, 0.5, 0.333333, 0.5, 90.0)
    assert found["true"]["false_alarm_rate"] is None and found["rules_2"]["accuracy"] == 0.5


def test_seen_arms_and_top_payment(spark):
    fit = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0)], "account_key string, y int")
    got = {r["account_key"]: (r["seen"], r["memory"]) for r in evaluation.seen_arms(fit, spark.createDataFrame([("a",), ("b",), ("c",)], "account_key string")).collect()}
    assert got == {"a": (True, 0.5), "b": (True, 0.0), "c": (False, None)}
    legs = spark.createDataFrame([("x", 3.0, 0), ("x", 3.0, 1), ("x", 1.0, 0), ("z", 2.0, 0), ("z", 1.0, 1)], "alert_id string, score double, y int")
    top = {r["alert_id"]: (r["top_score"], r["top_y"], r["any_y"]) for r in evaluation.top_payment(legs).collect()}
    assert top == {"x": (3.0, 1, 1), "z": (2.0, 0, 1)}
    assert {r["alert_id"]: r["auc"] for r in metrics.within_alert_auc(legs).collect()} == {"x": 0.75, "z": 0.0}


def test_strata_meet_all_negatives_of_their_fold(spark):
    r = random.Random(5)
    rows = [(f"f{i % 3}", float(r.randrange(12)), int(r.random() < 0.3) if i % 3 < 2 else 1, [s for s in ("p", "q") if r.random() < 0.5]) for i in range(150)]
    df = spark.createDataFrame(rows, "fold string, score double, y int, strata array<string>")
    found = {x["stratum"]: x for x in metrics.strata_auc(df, least_positive=3).collect()}
    for s in ("p", "q"):
        parts, n = [], 0
        for fold in ("f0", "f1", "f2"):
            pos = [v for f, v, y, names in rows if f == fold and y and s in names]
            neg = [v for f, v, y, _ in rows if f == fold and not y]
            n += len(pos)
            if pos and neg:
                parts.append((len(pos), sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)))
        assert found[s]["n_pos"] == n and found[s]["auc"] == pytest.approx(sum(p * a for p, a in parts) / sum(p for p, _ in parts))


def test_rule_evaluation_known_answers(spark):
    rows = [("a", True, True, 2, True), ("b", True, False, 1, False), ("c", False, True, 1, True), ("d", False, False, 0, True)]
    df = spark.createDataFrame(rows, "account_key string, fired_R1 boolean, fired_R2 boolean, n_rules_triggered long, is_pos boolean")
    found = {r["rule"]: tuple(r)[1:] for r in stats.rule_evaluation(df, 4).collect()}
    assert found == {"R1": (2, 1, 0.5, 0.25, 1, 0), "R2": (2, 2, 1.0, 0.5, 1, 1), "ALL": (3, 2, 0.666666667, 0.5, 2, 1)}
    assert {tuple(r) for r in stats.rules_histogram(df).collect()} == {(1, 2), (2, 1)}


def test_early_stopping_picks_the_best_prefix(spark):
    r = random.Random(2)
    rows = [(x := r.random(), r.random(), int(x + 0.3 * r.random() > 0.8), i < 300) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, y int, early boolean")
    fit, later = df.filter("early"), df.filter("NOT early")
    whole = models.fit_model("trees", fit, ["a", "b"], maxIter=6)
    steps = models.prefix_margins(whole, later)
    assert steps.groupBy("trees").count().count() == 6
    last = {round(x["a"], 12): x["score"] for x in steps.filter("trees = 6").collect()}
    for x in whole.transform(later).collect():
        assert x["rawPrediction"][1] == pytest.approx(last[round(x["a"], 12)])
    curve = {n: metrics.auc_ap(steps.filter(f"trees = {n}").selectExpr("y", "round(score, 12) AS score")).first()["ap"] for n in range(1, 7)}
    best = min(curve, key=lambda n: (-curve[n], n))
    assert models.boosted_with_early_stopping(fit, later, ["a", "b"], most_trees=6).stages[-1].getNumTrees == best


def test_shallow_trees_name_their_features(spark):
    rows = spark.createDataFrame([("x" if i % 3 else "y", float(i % 7), int(i % 3 == 0)) for i in range(200)], "kind string, v double, y int")
    ready, names = models.one_hot(rows, ["kind"])
    found = models.tree_summaries(ready, [*names, "v"], [1, 3]).collect()
    assert names == ["kind=x", "kind=y"] and found[0]["auc"] == 1.0 and "kind=" in found[0]["tree"] and [r["depth"] for r in found] == [1, 3]
    with pytest.raises(ValueError):
        models.one_hot(rows, ["kind"], most=1)


def test_stored_alerts_are_compared_with_recomputed_ones(spark):
    schema = "account_key string, window_start int, n_txn long, volume_usd double, triggered_rules array<string>"
    good = [("a", 1, 3, 5.0, ["R1"]), ("b", 1, 2, 7.0, ["R1", "R2"])]
    recomputed = spark.createDataFrame([*good, ("c", 1, 1, 1.0, [])], schema)
    def check(rows):
        return tuple(contracts.stored_integrity(spark.createDataFrame(rows, schema), recomputed, ["n_txn", "volume_usd"]).first())

    assert check(good) == (0, 0)
    assert check([good[0], ("b", 1, 2, 7.5, ["R1", "R2"])]) == (1, 0) and check([good[0], ("b", 1, 2, 7.0, ["R2", "R1"])]) == (0, 1) and check([("lost", 1, 3, 5.0, ["R1"])]) == (1, 1)


def test_a_repeated_alert_and_every_broken_condition_are_found(spark):
    at = datetime(2024, 1, 10)
    good = ("A0f", "1|a", at, at + timedelta(hours=23), at + timedelta(days=1), 1)
    schema = "alert_id string, account_key string, window_start timestamp_ntz, window_end timestamp_ntz, as_of timestamp_ntz, n_rules_triggered long"
    assert contracts.repeated(spark.createDataFrame([good, good, ("A1", *good[1:])], schema), "alert_id").collect()[0]["n"] == 2
    for place, value, name in ((0, "B", "id"), (1, "a", "composite key"), (2, at + timedelta(days=2), "window in order"), (3, at + timedelta(days=1), "window closed"), (5, 0, "one rule at least"), (5, None, "one rule at least")):
        row = [*good]
        row[place] = value
        assert name in contracts.violations(spark.createDataFrame([tuple(row)], schema), contracts.ALERT).first()["broken"]


def test_runtime_modules_do_not_reach_for_ground_truth():
    """Sources, hashes, and the streaming job neither name ground truth nor import what evaluates."""
    for folder in ("functions", "streaming"):
        for path in glob.glob(os.path.join(ROOT, "ledgerloom", folder, "*.py")):
            with open(path, encoding="utf-8") as f:
                source = f.read()
            assert not contracts.ground_truth_names(source) and not contracts.evaluation_imports(source, ("ledgerloom.operators.evaluation", "ledgerloom.operators.labels"))
    assert contracts.ground_truth_names("x = row.is_laundering\ny = f(planted=1)\nz = t['Typology Truth']") == ["Typology Truth", "is_laundering", "planted"]
    assert contracts.evaluation_imports("from ledgerloom.operators import labels\nimport os", ("ledgerloom.operators.labels",)) == ["ledgerloom.operators.labels"]
    assert ast.parse("1")


def test_simplest_wins_still_holds():
    assert selection.simplest_wins(["a", "b", "c"], {"a": 1.0, "b": 3.0, "c": 3.0}, {"b": 0.1, "c": 0.2}) == "b"
