"""Domain tests on small hand-made ledgers."""

import hashlib
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import hashing
from ledgerloom.operators import contracts, features, fx, graph, labels, ledger, metrics, models, profiles, ranks, stats
from ledgerloom.sources import tables
from ledgerloom.streaming import daily

LEDGER = "row_id long, ts timestamp_ntz, from_key string, to_key string, amount_received double, receiving_currency string, amount_paid double, payment_currency string, payment_format string, is_laundering int, attempt_id int"


def make(spark, rows):
    """rows: (minute, from, to, paid, pay currency, received, receive currency, format, laundering, attempt)"""
    start = datetime(2024, 1, 10)
    return spark.createDataFrame([(i, start + timedelta(minutes=m), a, b, rcv, rc, paid, pc, fmt, y, att) for i, (m, a, b, paid, pc, rcv, rc, fmt, y, att) in enumerate(rows)], LEDGER)


def usd(m, a, b, paid, fmt="ACH", y=0, att=None):
    return (m, a, b, paid, "US Dollar", paid, "US Dollar", fmt, y, att)


def random_rows(seed, n=300, people=12):
    r = random.Random(seed)
    names = [f"00{i % 3}|U{i}" for i in range(people)]
    return [usd(r.randrange(1440 * 2), r.choice(names), r.choice(names), r.choice([1000.0, 9500.0, 123.45, 5000.0, 20000.0]), r.choice(["ACH", "Cash", "Wire"])) for _ in range(n)]


def day_stats(df):
    return {(r["account_key"], str(r["window_start"])): r for r in stats.account_day_stats(ledger.legs(ledger.with_usd(df))).collect()}


def test_statistics_equal_plain_python(spark):
    rows = random_rows(1)
    found, plain = day_stats(make(spark, rows)), {}
    for m, a, b, paid, _, _, _, fmt, _, _ in rows:
        if a != b:
            day = str(datetime(2024, 1, 10) + timedelta(days=m // 1440))
            for who, other, way in ((a, b, "out"), (b, a, "in")):
                plain.setdefault((who, day), []).append((m, other, way, paid, fmt))
    assert set(found) == set(plain)
    for key, ls in plain.items():
        r = found[key]
        i, o = sum(x[3] for x in ls if x[2] == "in"), sum(x[3] for x in ls if x[2] == "out")
        first_in, last_out = min((x[0] for x in ls if x[2] == "in"), default=None), max((x[0] for x in ls if x[2] == "out"), default=None)
        through = min(i, o) if i > 0 and o > 0 and 0.8 <= o / i <= 1.25 and last_out > first_in else 0.0
        assert (r["n_txn"], r["n_near_threshold"], r["n_round_amounts"]) == (len(ls), sum(9000 <= x[3] < 10000 for x in ls), sum(x[3] >= 1000 and x[3] % 1000 == 0 for x in ls))
        assert (r["n_distinct_senders"], r["n_distinct_receivers"]) == (len({x[1] for x in ls if x[2] == "in"}), len({x[1] for x in ls if x[2] == "out"}))
        assert r["in_usd"] == pytest.approx(i) and r["pass_through_usd"] == pytest.approx(through) and r["high_risk_channel_usd"] == pytest.approx(sum(x[3] for x in ls if x[4] == "Cash"))


def test_point_in_time_bounds(spark):
    df = make(spark, [usd(m, "1|a", "2|b", 10.0) for m in (0, 1439, 1440, 1441)])
    seen = ledger.visible(df, datetime(2024, 1, 11), datetime(2024, 1, 10))
    assert seen.count() == 2
    with pytest.raises(ValueError):
        ledger.visible(df, datetime(2024, 1, 10), datetime(2024, 1, 10))


def test_future_and_order_do_not_matter(spark):
    rows = random_rows(2)
    first = [x for x in rows if x[0] < 1440]
    whole, alone, shuffled = day_stats(make(spark, rows)), day_stats(make(spark, first)), day_stats(make(spark, rows[::-1]))
    assert all(whole[k]["n_txn"] == v["n_txn"] and whole[k]["volume_usd"] == pytest.approx(v["volume_usd"]) for k, v in alone.items())
    assert {k: v["n_txn"] for k, v in whole.items()} == {k: v["n_txn"] for k, v in shuffled.items()}


@pytest.mark.parametrize("bad", ["Pound", None])
def test_unknown_currency_fails(spark, bad):
    df = make(spark, [(0, "1|a", "2|b", 5.0, bad, 5.0, "US Dollar", "ACH", 0, None)])
    with pytest.raises(Exception, match="unknown payment_currency"):
        ledger.with_usd(df).collect()


def test_one_period_is_required(spark):
    rows = spark.createDataFrame([(1, "TEST"), (2, "TEST"), (3, "TRAIN"), (4, None)], "id int, period string")
    assert ledger.require_period(rows.filter("id < 3"), "TEST").count() == 2
    for bad, found in ((3, "TRAIN"), (4, "no period")):
        with pytest.raises(Exception, match=f"a row of {found}"):
            ledger.require_period(rows.filter(f"id = {bad}"), "TEST").collect()


def test_row_outside_the_periods_fails(spark):
    df = spark.createDataFrame([(datetime(2025, 1, 1),)], "ts timestamp_ntz")
    with pytest.raises(Exception, match="no period"):
        ledger.refuse_outside(df).collect()


def test_rules_fire_by_peer_and_in_order(spark):
    df = spark.createDataFrame([("a", "x", 50.0, 3), ("b", "y", 50.0, 0), ("c", "z", 0.0, 9)], "account_key string, peer_group string, volume_usd double, n_near_threshold long")
    out = {r["account_key"]: r["triggered_rules"] for r in stats.fire(df, {"R03_STRUCTURING": 2, "R02_PEER_VOLUME_OUTLIER": {"x": 40.0, None: 60.0}}).collect()}
    assert out == {"a": ["R03_STRUCTURING", "R02_PEER_VOLUME_OUTLIER"], "b": [], "c": ["R03_STRUCTURING"]}
    with pytest.raises(ValueError):
        stats.fire(df, {"R99": 1})


def test_quantiles_and_calibration(spark):
    r = random.Random(0)
    values = [r.randrange(40) for _ in range(137)]
    df = spark.createDataFrame([(float(v),) for v in values], "n_txn double")
    for row in stats.higher_quantiles(df, ["n_txn"], [0.0, 0.5, 0.93, 1.0]).collect():
        assert row["threshold"] == sorted(values)[stats.rank_of(row["tau"], len(values)) - 1]
    peers = {r["peer_group"]: (r["n_rows"], r["threshold"]) for r in stats.peer_thresholds(df.withColumn("peer", F.pmod(F.col("n_txn").cast("int"), F.lit(2)).cast("string")), "n_txn", 0.5, "peer", 60).collect()}
    for group in ("0", "1"):
        own = sorted(v for v in values if v % 2 == int(group))
        pool = own if len(own) >= 60 else sorted(values)
        assert peers[group] == (len(own), pool[stats.rank_of(0.5, len(pool)) - 1])


def _plain_calibration(rows, taus, n_positive, method, least_precision, least_true, target, band, too_strong):
    """The calibration by plain loops over dicts of statistics."""
    def threshold(stat, floor, tau):
        v = sorted(r[stat] for r in rows)
        return max(floor, v[stats.rank_of(tau, len(v)) - 1])

    grid = {(rule, t): threshold(stat, floor, t) for rule, (stat, floor) in stats.RULES.items() for t in taus}
    hits = {(rule, t): [r["is_pos"] for r in rows if r[stats.RULES[rule][0]] > 0 and r[stats.RULES[rule][0]] >= grid[rule, t]] for rule, t in grid}
    if method == "global":
        def layer(t):
            return [r["is_pos"] for r in rows if any(r[s] > 0 and r[s] >= grid[rule, t] for rule, (s, _) in stats.RULES.items())]

        inside = [t for t in taus if layer(t) and band[0] <= sum(layer(t)) / len(layer(t)) <= band[1]]
        chosen = dict.fromkeys(stats.RULES, min(inside, key=lambda t: (abs(np.log(sum(layer(t)) / len(layer(t)) / target)), -sum(layer(t)))))
    else:
        chosen = {}
        for rule in stats.RULES:
            for t in reversed(taus):
                x = hits[rule, t]
                if x and sum(x) / len(x) >= least_precision and sum(x) >= least_true:
                    chosen[rule] = t
                    break
    for rule in list(chosen):
        while rule in chosen and (x := hits[rule, chosen[rule]]) and sum(x) / len(x) > too_strong[0] and sum(x) / n_positive > too_strong[1]:
            at = taus.index(chosen[rule]) + 1
            if at == len(taus):
                del chosen[rule]
            else:
                chosen[rule] = taus[at]
    return chosen, {rule: grid[rule, t] for rule, t in chosen.items()}


@pytest.mark.parametrize("method", ["global", "per_rule"])
def test_calibration_equals_plain_loops(spark, method):
    r = random.Random(6)
    rows = []
    for i in range(400):
        y = r.random() < 0.15
        rows.append({c: float(r.randrange(12) * (3 if y and c in ("max_txn_usd", "n_txn") else 1) * (2000 if c.endswith("usd") else 1)) for c in stats.STATS} | {"account_key": f"a{i}", "is_pos": y})
    df = spark.createDataFrame([tuple(x.values()) for x in rows], ", ".join([*(f"{c} double" for c in stats.STATS), "account_key string", "is_pos boolean"]))
    n_positive, taus = sum(x["is_pos"] for x in rows), [0.99, 0.95, 0.9, 0.5, 0.0]
    args = {"least_precision": 0.15, "least_true": 3, "target": 0.2, "band": (0.01, 0.9), "too_strong": (0.5, 0.05)}
    found = stats.calibrate(df, taus, n_positive=n_positive, method=method, most_recall=1.01, least_rules=1, **args)
    chosen, limits = _plain_calibration(rows, taus, n_positive, method, **args)
    assert found["taus"] == chosen and found["thresholds"] == limits and (method == "per_rule" or any(a["action"] == "loosen" for a in found["actions"]))
    fired = [x for x in rows if any(x[stats.RULES[k][0]] > 0 and x[stats.RULES[k][0]] >= v for k, v in limits.items())]
    assert (found["n_alerts"], found["n_true"]) == (len(fired), sum(x["is_pos"] for x in fired))
    for bad in ({"least_rules": 10}, {"most_recall": 0.0}, {"band": (0.95, 1.0)}):
        with pytest.raises(ValueError):
            stats.calibrate(df, taus, n_positive=n_positive, method=method, **{**args, "most_recall": 1.01, "least_rules": 1, **bad})
    with pytest.raises(ValueError, match="strict to loose"):
        stats.calibrate(df, taus[::-1], n_positive=n_positive)


def test_alert_ids_are_keyed_hashes(spark):
    made = stats.alerts(stats.fire(stats.account_day_stats(ledger.legs(ledger.with_usd(make(spark, random_rows(3)))))))
    for r in made.collect():
        key = hashlib.blake2b(b"alert_id|0", digest_size=32).digest()
        assert r["alert_id"] == "A" + hashlib.blake2b(f"main|{r['account_key']}|{r['window_start']:%Y-%m-%d}".encode(), digest_size=8, key=key).hexdigest()
        assert r["as_of"] - r["window_end"] == timedelta(seconds=1)
    assert contracts.violations(made, contracts.ALERT).count() == 0 and contracts.repeated(made, "alert_id").count() == 0
    broken = made.limit(1).withColumn("window_end", F.col("as_of"))
    assert contracts.violations(broken, contracts.ALERT).first()["broken"] == ["window closed"]


def test_rates_from_conversions(spark):
    rows = [(i, "1|a", "2|b", 10.0, "Euro", 12.5, "US Dollar", "Wire", 0, None) for i in range(5)] + [(9, "1|a", "2|b", 100.0, "Yen", 0.8, "Euro", "Wire", 0, None)]
    assert fx.derive_rates(make(spark, rows)) == pytest.approx({"US Dollar": 1.0, "Euro": 1.25, "Yen": 0.01})
    lost = [*rows, (9, "1|a", "2|b", 1.0, "Pound", 1.0, "Pound", "Wire", 0, None)]
    with pytest.raises(ValueError, match="Pound"):
        fx.derive_rates(make(spark, lost))


def test_graph_known_answers(spark):
    e = graph.edges(make(spark, [usd(0, a, b, 1.0) for a, b in ("ab", "bc", "ca", "ba", "cd", "xy", "xx")]))
    rec = {r["account_key"]: r["reciprocal_cp"] for r in graph.reciprocal(e).collect()}
    cyc = {r["account_key"]: r["cycles3"] for r in graph.cycles3(e).collect()}
    reach = {r["account_key"]: (r["reach2_out"], r["reach2_in"]) for r in graph.reach2(e).collect()}
    size = {r["account_key"]: round(10 ** r["wcc_log10_size"]) for r in graph.component_sizes(graph.components(e)).collect()}
    assert rec == {"a": 1.0, "b": 1.0} and cyc == {"a": 1.0, "b": 1.0, "c": 1.0}
    assert reach["a"] == (1.0, 1.0) and reach["b"] == (2.0, 1.0) and size == dict.fromkeys("abcd", 4) | dict.fromkeys("xy", 2)


def test_components_equal_union_find(spark):
    r = random.Random(8)
    pairs = [(r.randrange(3), f"n{r.randrange(80):03}", f"n{r.randrange(80):03}") for _ in range(120)] + [(9, f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    found = {(x["g"], x["node"]): x["root"] for x in graph.components(spark.createDataFrame(pairs, "g int, src string, dst string"), "g").collect()}
    parent = {(g, n): n for g, a, b in pairs for n in (a, b)}

    def top(g, n):
        while parent[g, n] != n:
            n = parent[g, n]
        return n

    for g, a, b in pairs:
        x, y = top(g, a), top(g, b)
        parent[g, max(x, y)] = min(x, y)
    assert found == {(g, n): top(g, n) for g, n in parent}


def test_dynamics_and_concentration(spark):
    rows = [usd(0, "a", "b", 10.0), usd(30, "b", "a", 30.0), usd(45, "a", "c", 30.0), usd(200, "a", "b", 30.0)]
    legs = ledger.legs(ledger.with_usd(make(spark, rows)))
    d = {r["account_key"]: r for r in features.dynamics(legs).collect()}["a"]
    assert (d["active_hours"], d["max_txn_per_hour"], d["median_interarrival_min"], d["in_to_out_lag_min"]) == (2.0, 3.0, 30.0, 15.0) and d["span_hours"] == pytest.approx(200 / 60)
    c = {r["account_key"]: r for r in features.concentration(legs).collect()}["a"]
    assert c["cp_hhi"] == pytest.approx(0.7**2 + 0.3**2) and (c["n_counterparties"], c["max_txn_one_cp"]) == (2.0, 3.0)


def test_feature_table_has_no_nulls(spark):
    t = ledger.with_usd(make(spark, random_rows(6)))
    legs = ledger.legs(t)
    fired = stats.fire(stats.account_day_stats(legs))
    targets = fired.filter("n_rules_triggered > 0").select("account_key", "window_start")
    table = features.feature_table(t, legs, fired, graph.graph_features(graph.edges(t), targets), targets).toPandas()
    assert len(table) == targets.count() and len(table.columns) == 2 + 61 + 3
    assert not table.drop(columns=["account_key", "window_start"]).map(lambda v: v is None).any().any()


def test_capped_sample_keeps_positives_and_total(spark):
    rows = [usd(i, "a", "b", 1.0 + i, y=int(i % 10 == 0)) for i in range(50)]
    legs = ledger.legs(ledger.with_usd(make(spark, rows)))
    kept = features.capped_sample(legs, 5, "row_id").filter("account_key = 'a'").collect()
    assert sum(r["is_laundering"] for r in kept) == 5 and len(kept) == 10 and sum(r["weight"] for r in kept) == pytest.approx(50)


def test_labels_and_holdout(spark):
    rows = [usd(0, "a", "b", 1.0, y=1, att=3), usd(5, "a", "b", 1.0, y=1), usd(9, "c", "d", 1.0)]
    legs = ledger.legs(ledger.with_usd(make(spark, rows)))
    day = {r["account_key"]: r for r in labels.positive_days(labels.laundering_legs(legs)).collect()}["a"]
    assert (day["n_laundering_txns"], day["attempt_ids"], day["has_unattributed"]) == (2, [3], True)
    alerts = stats.account_day_stats(legs).select("account_key", "window_start")
    done = labels.keep_count(alerts, labels.label_alerts(alerts, labels.positive_days(labels.laundering_legs(legs))), "labels")
    assert {r["account_key"]: r["is_true_positive"] for r in done.collect()} == {"a": True, "b": True, "c": False, "d": False}
    opened = []
    with pytest.raises(labels.HoldoutRefused):
        labels.load_labels(lambda: opened.append(1), ["TRAIN", "TEST"])
    assert not opened


def test_metrics_equal_brute_force(spark):
    r = random.Random(4)
    data = [(r.randrange(15) / 10, int(r.random() < 0.3), f"u{r.randrange(30)}") for _ in range(200)]
    df = spark.createDataFrame(data, "score double, y int, unit string")
    pos, neg = [s for s, y, _ in data if y], [s for s, y, _ in data if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    row = metrics.auc_ap(df).first()
    assert row["auc"] == pytest.approx(auc, abs=1e-8)
    s, y = np.array([x[0] for x in data]), np.array([x[1] for x in data], float)
    assert metrics.tied_auc_ap(s, y, np.ones(200)) == pytest.approx((row["auc"], row["ap"]), abs=1e-8)
    for ratio in (20.0, 0.2):
        costs = {t: (ratio * sum(a < t for a in pos) + sum(b >= t for b in neg), sum(s >= t)) for t in {*s, float("inf")}}
        best = metrics.cost_threshold(df, ratio).first()
        assert (best["cost"], best["n_flagged"]) == pytest.approx(min(costs.values()))
    bad = metrics.cost_threshold(spark.createDataFrame([(0.9, 0), (0.8, 0), (0.7, 0), (0.1, 1)], "score double, y int"), 2.0).first()
    assert tuple(bad) == (float("inf"), 2.0, 0, 0)
    one, two = metrics.bootstrap(df, "unit", 8).orderBy("replicate").collect(), metrics.bootstrap(df.repartition(3), "unit", 8).orderBy("replicate").collect()
    assert [x["replicate"] for x in one] == list(range(8)) and np.allclose([x["ap"] for x in one], [x["ap"] for x in two])
    assert metrics.permutation_p(1.0, [0.0] * 9) == 0.1
    held, spread = (metrics.bootstrap(df, "unit", 300, most_rows=n).agg(F.avg("ap").alias("m"), F.stddev("ap").alias("s"), F.avg("auc").alias("a"), F.count("ap").alias("n")).first() for n in (1000, 10))
    assert held["n"] == spread["n"] == 300 and spread["m"] == pytest.approx(held["m"], abs=0.02) and spread["a"] == pytest.approx(held["a"], abs=0.02) and spread["s"] == pytest.approx(held["s"], rel=0.3)


def test_hashes_and_draws_are_pinned(spark):
    """Values by the public algorithms alone: keyed BLAKE2b, splitmix64 and the top 53 bits."""
    def mix(x):
        m = (1 << 64) - 1
        z = (x + 0x9E3779B97F4A7C15) & m
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
        return z ^ (z >> 31)

    names = ["", "000|U1", "é", "a" * 300]
    df = spark.createDataFrame([(x,) for x in names], "k string").select("k", hashing.keyed_hex("demo", 1)(F.col("k")).alias("hex"), hashing.keyed_uniform("demo", 1, "u")(F.col("k")).alias("u"))
    key = hashlib.blake2b(b"demo|1", digest_size=32).digest()
    salt = int.from_bytes(hashlib.blake2b(b"u", digest_size=8).digest(), "little")
    found = {r["k"]: (r["hex"], r["u"]) for r in df.collect()}
    for x in names:
        digest = hashlib.blake2b(x.encode(), digest_size=8, key=key)
        assert found[x] == (digest.hexdigest(), (mix(int.from_bytes(digest.digest(), "little") ^ salt) >> 11) / 2**53)
    assert mix(0) == 0xE220A8397B1DCDAF  # the algorithm's published first value


def test_hashes_and_draws(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k")).withColumn("u", hashing.keyed_uniform("p", 1, "s")(F.col("k"))).withColumn("c", hashing.choose(F.col("u"), ["x", "y"], [1, 3]))
    got = df.groupBy("c").count().collect()
    assert abs({r["c"]: r["count"] for r in got}["x"] - 500) < 80
    with pytest.raises(ValueError):
        hashing.choose(F.col("u"), ["x"], [-1.0])
    z = spark.createDataFrame([(0.5,), (0.975,)], "p double").select(hashing.normal_quantile(F.col("p")).alias("z")).collect()
    assert z[0]["z"] == pytest.approx(0) and z[1]["z"] == pytest.approx(1.959964, abs=1e-5)


def test_attributes_fail_for_an_unknown_account(spark):
    known = spark.createDataFrame([("1", "U1", "Chad Bank #3", "Corp")], "bank_id string, account_number string, bank_name string, entity_type string")
    keys = spark.createDataFrame([("001|U1",)], "account_key string")
    first = profiles.account_attributes(keys, known, ["Chad"]).first()
    assert (first["bank_location"], first["bank_country"]) == ("Chad", "Chad")
    with pytest.raises(Exception, match="no account for"):
        profiles.account_attributes(spark.createDataFrame([("001|U2",)], "account_key string"), known, ["Chad"]).collect()
    with pytest.raises(Exception, match="unknown place of a bank: Chad"):
        profiles.account_attributes(keys, known, ["France"]).collect()
    others = spark.createDataFrame([("1", "U1", "Crytpo Bank #77", "Corp"), ("1", "U3", "First Bank of Miami", "Corp")], "bank_id string, account_number string, bank_name string, entity_type string")
    found = profiles.account_attributes(spark.createDataFrame([("001|U1",), ("01|U3",)], "account_key string"), others, ["Chad"]).orderBy("account_key").collect()
    assert [(r["bank_location"], r["bank_country"]) for r in found] == [("Crytpo", "Crypto"), ("United States", "United States")]


def test_flagged_counterparties_are_confirmed_and_closed(spark):
    day = 1440
    rows = [usd(day + 5, "1|a", "2|b", 1.0), usd(day + 6, "1|c", "1|a", 1.0), usd(day + 7, "1|a", "2|d", 1.0), usd(2 * day + 1, "1|a", "2|e", 1.0)]
    legs = ledger.legs(ledger.with_usd(make(spark, rows)))
    closed = [("2|b", "confirmed_suspicious", datetime(2024, 1, 11, 23)), ("1|c", "closed_legitimate", datetime(2024, 1, 10)), ("2|d", "confirmed_suspicious", datetime(2024, 1, 12)), ("2|e", "confirmed_suspicious", datetime(2024, 1, 1))]
    given = spark.createDataFrame(closed, "account_key string, disposition string, closed_at timestamp_ntz")
    for days, expected in ((1, {"2024-01-12": (3, 1), "2024-01-13": (1, 1)}), (2, {"2024-01-12": (3, 1), "2024-01-13": (4, 3), "2024-01-14": (1, 1)})):
        found = profiles.flagged_counterparties(legs, given, days).filter("account_key = '1|a'").collect()
        assert {f"{r['as_of']:%Y-%m-%d}": (r["n_counterparties"], r["n_flagged"]) for r in found} == expected


def test_profiles_follow_their_rules(spark):
    rules = profiles.ProfileRules(
        sectors={"trade": (1, "low"), "cash": (1, "high")}, occupations={"clerk": (1, "low")}, individual_types=("Person",), public_types=("State",), band_noise=0.0, rating_noise=0.0,
        behaviours={"volume": "volume_usd", "senders": "n_senders"}, archetypes={"volume": ("trade",), "senders": ("cash",)}, planted_occupation="dealer",
    )
    rules = profiles.ProfileRules(**{**rules.__dict__, "occupations": {"clerk": (1, "low"), "dealer": (0, "high")}})
    kinds = ["Person", "Corp", "State"]
    attributes = spark.createDataFrame([(f"a{i:03}", kinds[i % 3], "X", ["United States", "Crypto", "Chad"][i % 3 if i < 99 else 1]) for i in range(120)], "account_key string, entity_type string, bank_location string, bank_country string")
    volume = spark.createDataFrame([(f"a{i:03}", float(i)) for i in range(90)], "account_key string, volume_usd double")
    base = profiles.base_profile(attributes, volume, rules)
    rows = {r["account_key"]: r for r in base.collect()}
    assert len(rows) == 120 and all(2005 <= r["onboarding_year"] <= 2022 for r in rows.values())
    for i in range(120):
        r = rows[f"a{i:03}"]
        assert r["sector_or_occupation"] in {"Person": ("clerk", "dealer"), "Corp": ("trade", "cash"), "State": (profiles.GOVERNMENT,)}[kinds[i % 3]]
        assert r["country_risk"] == {"United States": "low", "Crypto": "high"}.get(r["bank_country"], r["country_risk"])
        if i < 90:  # 30 of a type, ranked by volume
            percentile = (i // 3 + 1) / 30
            assert r["expected_activity_band"] == rules.bands[sum(percentile > c for c in rules.band_cuts)]
    assert len({r["country_risk"] for r in rows.values() if r["bank_country"] == "Chad"}) == 1
    day = spark.createDataFrame([(f"a{i:03}", datetime(2024, 1, 1), float(i), 0 if i % 2 else i) for i in range(60)], "account_key string, window_start timestamp_ntz, volume_usd double, n_senders int")
    planted, record = profiles.plant(base, day, rules)
    marks = {r["account_key"]: r for r in record.collect()}
    assert {k for k, r in marks.items() if r["planted"]} == {f"a{i:03}" for i in (52, 54, 56, 57, 58, 59)} and len(marks) == 60
    assert marks["a058"]["dominant_behaviour"] == "senders" and marks["a059"]["dominant_behaviour"] == "volume" and marks["a001"]["dominant_behaviour"] == "volume"
    after = {r["account_key"]: r for r in planted.collect()}
    assert after["a058"]["sector_or_occupation"] == "cash" and after["a057"]["sector_or_occupation"] == "dealer" and after["a056"]["sector_or_occupation"] == profiles.GOVERNMENT
    assert after["a058"]["expected_activity_band"] in ("high", "very_high") and after["a001"] == rows["a001"]
    for r in profiles.risk_rating(planted, rules).collect():
        points = {"trade": 0, "cash": 2, "clerk": 0, "dealer": 2, profiles.GOVERNMENT: 0}[r["sector_or_occupation"]] + profiles.RISK_POINTS[r["country_risk"]] + (r["expected_activity_band"] == "very_high")
        assert r["risk_points"] == points and r["customer_risk_rating"] == ("high" if points >= 3 else "medium" if points >= 2 else "low")


def test_leg_features_known_answers(spark):
    rows = [usd(0, "1|a", "2|b", 9500.0, "Wire"), usd(1, "1|a", "2|b", 9500.0), usd(2, "1|c", "1|a", 2000.0), usd(3, "2|b", "1|c", 9500.0), usd(1441, "1|a", "2|b", 7.0)]
    legs = ledger.legs(ledger.with_usd(make(spark, rows)))
    found = features.leg_features(legs, spark.createDataFrame([("1|a", datetime(2024, 1, 10))], "account_key string, window_start timestamp_ntz")).orderBy("row_id").collect()
    assert [(r["row_id"], r["account_key"]) for r in found] == [(0, "1|a"), (1, "1|a"), (2, "1|a")] and len(features.leg_feature_names()) == 21
    a, c = found[0], found[2]
    assert (a["is_out"], a["cross_bank"], a["near_threshold"], a["round_amount"], a["leg_fmt_wire"], a["leg_fmt_ach"]) == (1.0, 1.0, 1.0, 0.0, 1.0, 0.0)
    assert (c["is_out"], c["cross_bank"], c["near_threshold"], c["round_amount"]) == (0.0, 0.0, 0.0, 1.0)
    assert a["share_of_account_volume"] == pytest.approx(9500 / 21000) and c["log10_ratio_to_account_median"] == pytest.approx(np.log10(2000 / 9500))
    assert a["log10_account_n_legs"] == pytest.approx(np.log10(3)) and a["log10_cp_n_legs"] == pytest.approx(np.log10(3)) and a["log10_pair_n_txn"] == pytest.approx(np.log10(2)) and a["log10_same_amount_n"] == pytest.approx(np.log10(3))
    assert a["log10_cp_out_deg"] == pytest.approx(np.log10(2)) and a["log10_cp_in_deg"] == pytest.approx(np.log10(2)) and c["log10_cp_in_deg"] == pytest.approx(np.log10(2))


def test_cycles_equal_brute_force(spark):
    r = random.Random(12)
    pairs = {(f"n{r.randrange(14):02}", f"n{r.randrange(14):02}") for _ in range(70)} | {("hub", f"n{i:02}") for i in range(14)} | {(f"n{i:02}", "hub") for i in range(0, 14, 2)}
    e = graph.edges(make(spark, [usd(0, a, b, 1.0) for a, b in pairs]))
    real = {(a, b) for a, b in pairs if a != b}
    expected = {}
    for v, u in real:
        for u2, w in real:
            if u2 == u and w != v and (w, v) in real:
                expected[v] = expected.get(v, 0) + 1
    assert {x["account_key"]: x["cycles3"] for x in graph.cycles3(e).collect()} == expected
    some = spark.createDataFrame([("hub", datetime(2024, 1, 10)), ("n03", datetime(2024, 1, 10))], "account_key string, window_start timestamp_ntz")
    assert {x["account_key"]: x["cycles3"] for x in graph.cycles3(e, some).collect()} == {k: v for k, v in expected.items() if k in ("hub", "n03")}


def test_ranks_equal_plain_python(spark):
    r = random.Random(3)
    data = [(i, r.choice("ab") if i % 9 else None, float(r.randrange(40)) if r.random() < 0.9 else None, r.randrange(5)) for i in range(500)] + [(1000 + i, "hot", 7.0, 1) for i in range(400)]
    df = spark.createDataFrame(data, "id long, g string, v double, w long")
    for down in (False, True):
        for row in ranks.running(df, "v", {"upto": "w"}, "g", descending=down).collect():
            def before(x):
                if row["v"] is None or x is None:
                    return row["v"] == x or ((x is None) != down if row["v"] is not None else down)
                return x >= row["v"] if down else x <= row["v"]

            same = [(v, w) for _, g, v, w in data if g == row["g"]]
            assert row["upto"] == sum(w for v, w in same if before(v)) and row["all_upto"] == sum(w for _, w in same)
    found = {x["id"]: x["pct_v"] for x in ranks.average_percentiles(df, ["v"], ["id"], "g").collect()}
    for i, g, v, _ in data:
        pool = [x for _, h, x, _ in data if h == g and x is not None]
        if v is not None:
            assert found[i] == pytest.approx((sum(x < v for x in pool) + (sum(x == v for x in pool) + 1) / 2) / len(pool))
    spots = r.sample(range(10_000), 300)
    rows = spark.createDataFrame([(p, p * 7 % 11) for p in spots], "p long, x long")
    order = sorted(spots)
    for step in (1, -1):
        got = {x["p"]: x["near_x"] for x in ranks.with_neighbour(rows, "p", ["x"], step, 1, 64).collect()}
        for at, p in enumerate(order):
            other = at + step
            assert got[p] == (order[other] * 7 % 11 if 0 <= other < len(order) else None)


def test_split_counts_crossing_and_moves(spark):
    members = spark.createDataFrame([("a", "t1"), ("b", "t1"), ("b", "t2"), ("c", "t2"), ("d", "t3")], "account_key string, member string")
    whole = labels.entity_split(members, [("x", 1.0)])
    assert {(r["node"], r["root"]) for r in whole.collect()} >= {("d", whole.filter("node = 'd'").first()["root"])} and whole.select("root").distinct().count() == 2
    assert [tuple(r) for r in labels.group_counts(members, whole).collect()] == [("x", 2, 4, 3, 3)] and labels.crossing(members, whole).count() == 0
    broken = spark.createDataFrame([("a", "r", "x"), ("b", "r", "x"), ("c", "r", "y"), ("d", "s", "y")], "node string, root string, agent_group string")
    assert [r["member"] for r in labels.crossing(members, broken).collect()] == ["t2"]
    before, after = (spark.createDataFrame(x, "alert_id string, agent_group string") for x in ([("1", "x"), ("2", "x"), ("3", "y")], [("1", "x"), ("2", "y"), ("4", "x")]))
    assert [tuple(r) for r in labels.moved_alerts(before, after).collect()] == [("x", "y", 1)]
    assert labels.choose_variant(["v1", "v2"], {"v1": {"enough": False}, "v2": {"enough": True}}) == "v2"
    with pytest.raises(ValueError):
        labels.choose_variant(["v1"], {"v1": {"enough": False}})
    shares = spark.createDataFrame([(0.0,), (0.25,), (1.0,), (1.5,)], "s double").select(labels.share_bin("s", [0.0, 0.25, 1.0]).alias("b")).collect()
    assert [r["b"] for r in shares] == ["[0,0.25)", "[0.25,1)", "[0.25,1)", None]


def test_models_and_store(spark, tmp_path):
    r = random.Random(0)
    rows = spark.createDataFrame([(float(x), float("nan") if i % 7 == 0 else 1.0, int(x + r.random() > 1.2), x > 0.8) for i, x in enumerate(r.random() * 2 for _ in range(300))], "a double, b double, y int, fired_R1 boolean")
    ready, names = models.standardised(rows, rows, ["a", "b"])
    scored = models.positive_score(models.fit_model("logistic", ready, names), ready)
    assert metrics.auc_ap(scored.select("score", "y")).first()["auc"] > 0.9
    assert models.rule_weights(rows)["fired_R1"] > 0 and models.rule_count(rows).agg(F.max("score")).first()[0] == 1.0
    name = models.save_document(spark, str(tmp_path), {"w": [1, 2], "é": "x"})
    assert models.load_document(spark, str(tmp_path), name) == {"w": [1, 2], "é": "x"}
    (tmp_path / ("0" * 64 + ".json")).write_text('{"w":[1,3]}')
    with pytest.raises(ValueError):
        models.load_document(spark, str(tmp_path), "0" * 64)
    with pytest.raises(FileNotFoundError):
        models.load_document(spark, str(tmp_path), "1" * 64)
    assert not tables.is_current(spark, str(tmp_path), "k")
    tables.mark_current(spark, str(tmp_path), "k", rows=3)
    assert tables.is_current(spark, str(tmp_path), "k")
    with pytest.raises(ValueError, match="other inputs"):
        tables.is_current(spark, str(tmp_path), "other")


CSV = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"
LINE = "2022/09/01 00:20,010,8000EBD30,10,8000EBD31,3697.34,US Dollar,3697.34,US Dollar,Reinvestment,0"


def test_csv_is_strict(spark, tmp_path):
    good = tmp_path / "t.csv"
    good.write_text("\n".join([CSV, LINE, LINE.replace("00:20", "00:21")]) + "\n")
    rows = tables.read_transactions(spark, str(good), CSV.split(",")).collect()
    assert [r["row_id"] for r in rows] == [0, 1] and rows[0]["from_bank"] == "010" and rows[0]["timestamp"] == datetime(2022, 9, 1, 0, 20)
    with pytest.raises(ValueError):
        tables.read_transactions(spark, str(good), ["other"])
    (tmp_path / "bad.csv").write_text("\n".join([CSV, LINE.replace("3697.34", "many")]) + "\n")
    with pytest.raises(Exception):
        tables.read_transactions(spark, str(tmp_path / "bad.csv")).collect()
    assert tables.csv_profile(spark, str(good)).first()["n_fields"] == 11
    assert tables.file_profiles(spark, str(good)).first()["newlines"] == 3
    files = {"plain": b"a\nb\n", "open": b"a\r\nb\r", "mark": b"\xef\xbb\xbfa\n", "bad": b"\xff\xfe\nx", "empty": b"", "ends": b"a\r\n\r\n", "long": b"".join(b"%d\r\n" % i for i in range(30_000))}
    folder = tmp_path / "files"
    folder.mkdir()
    for name, raw in files.items():
        (folder / name).write_bytes(raw)
    for r in tables.file_profiles(spark, str(folder)).collect():
        raw = files[r["path"].rsplit("/", 1)[1]]
        assert (r["bytes"], r["sha256"], r["newlines"], r["crlf"], r["utf8"], r["bom"]) == (len(raw), hashlib.sha256(raw).hexdigest(), raw.count(b"\n"), raw.count(b"\r\n"), b"\xff" not in raw, raw.startswith(b"\xef\xbb\xbf"))
    tables.verify_file(spark, str(good), good.stat().st_size, hashlib.sha256(good.read_bytes()).hexdigest())
    with pytest.raises(ValueError, match="not the registered file"):
        tables.verify_file(spark, str(good), good.stat().st_size, "0" * 64)
    (tmp_path / "q.csv").write_text('a,"b,c",d\n"open,e\n')
    assert {(r["n_fields"], r["n_open_quotes"]) for r in tables.csv_profile(spark, str(tmp_path / "q.csv")).collect()} == {(3, 0), (2, 1)}
    assert tables.unique_names(["Account", "To", "Account"]) == ["Account", "To", "Account_2"]
    two = tmp_path / "two"
    two.mkdir()
    (two / "a.csv").write_text(CSV + "\n" + LINE + "\n")
    (two / "b.csv").write_text("other\n" + LINE + "\n")
    with pytest.raises(ValueError, match="header"):
        tables.read_transactions(spark, str(two), CSV.split(","))
    (tmp_path / "acc.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nChad Bank #1,012,U1,E1,Sole Proprietorship #12\nX,3,U2,E2,Someone\n")
    accounts = tables.read_accounts(spark, str(tmp_path / "acc.csv"), ["Bank Name", "Bank ID", "Account Number", "Entity ID", "Entity Name"]).orderBy("row_id").collect()
    assert [(r["row_id"], r["bank_id"], r["entity_type"]) for r in accounts] == [(0, "012", "Sole Proprietorship"), (1, "3", None)]
    assert tables.line_templates(spark, str(good)).first()["n"] == 2


def test_patterns(spark, tmp_path):
    f = tmp_path / "p.txt"
    f.write_text("\n".join(["BEGIN LAUNDERING ATTEMPT - CYCLE:  Max 3 hops", LINE, LINE, "END LAUNDERING ATTEMPT - CYCLE", "", "BEGIN LAUNDERING ATTEMPT - STACK", LINE, "END LAUNDERING ATTEMPT - STACK"]))
    rows = tables.read_patterns(spark, str(f)).orderBy("attempt_id", "txn_index").collect()
    assert [(r["attempt_id"], r["typology"], r["typology_param"], r["txn_index"]) for r in rows] == [(0, "CYCLE", 3, 0), (0, "CYCLE", 3, 1), (1, "STACK", None, 0)]
    quoted = LINE.replace("US Dollar", '"US, Dollar"')
    assert tables.parse_patterns(["BEGIN LAUNDERING ATTEMPT - STACK", quoted, "END LAUNDERING ATTEMPT - STACK"])[0][4][6] == "US, Dollar"
    census = {(r["kind"], r["typology"], r["parameter"]): r["n"] for r in tables.block_census(spark, str(f)).collect()}
    assert census == {("begin", "CYCLE", 3): 1, ("begin", "STACK", None): 1, ("end", "CYCLE", None): 1, ("end", "STACK", None): 1, ("payment", None, None): 3, ("blank", None, None): 1}
    begin, end = "BEGIN LAUNDERING ATTEMPT - CYCLE", "END LAUNDERING ATTEMPT - CYCLE"
    for bad in ([begin, begin], [end], [begin, LINE, "END LAUNDERING ATTEMPT - STACK"], [begin, end], [LINE], [begin, LINE], [begin, "a,b", end]):
        with pytest.raises(ValueError):
            tables.parse_patterns(bad)


def test_catalog_refuses(spark, tmp_path):
    c = tables.Catalog(spark, str(tmp_path))
    c.write(spark.range(3), "runtime", "alerts")
    assert c.scan("runtime", "alerts").count() == 3 and c.describe("runtime", "alerts")[1] == 3
    c.write(spark.range(50).select(F.expr("id % 7 AS k"), "id").repartition(1), "runtime", "kyc", sort_by=["k", "id"])
    stored = [(r["k"], r["id"]) for r in c.scan("runtime", "kyc").collect()]
    assert stored == sorted(stored)
    both = tables.relaxed_union(spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2.5, True)], "a double, c boolean"))
    assert both.dtypes == [("a", "double"), ("b", "string"), ("c", "boolean")] and both.count() == 2
    for store, name in (("eval", "alert_labels"), ("runtime", "../eval"), ("runtime", "secret")):
        with pytest.raises(PermissionError):
            c.scan(store, name)
    assert tables.cache_key(a=1, b=2) == tables.cache_key(b=2, a=1) != tables.cache_key(a=1)


def test_forbidden_fields_and_differences(spark):
    df = spark.createDataFrame([(1, (2, [(3,)]))], "a int, s struct<x:int, l:array<struct<Is_Laundering:int>>>")
    assert contracts.forbidden_fields(df.schema) == ["s.l[].Is_Laundering"]
    a = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (2, float("nan")), (4, 1.0)], "k int, v double")
    assert sorted(r["k"] for r in contracts.differences(a, b, ["k"]).collect()) == [3, 4]


def test_stream_equals_batch(spark, tmp_path):
    legs = ledger.legs(ledger.with_usd(make(spark, random_rows(7)))).withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "account_key", "counterparty", "direction", "usd")
    late = legs.limit(1).withColumn("ts", F.lit("2024-02-01").cast("timestamp"))
    source = str(tmp_path / "in")
    legs.coalesce(1).write.parquet(source)
    late.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(legs.schema).parquet(source)
    run = daily.daily_statistics(stream).writeStream.format("memory").queryName("daily").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    got = {(r["account_key"], str(r["window_start"])): (r["n_txn"], r["n_distinct_senders"], r["n_distinct_receivers"]) for r in spark.table("daily").collect()}
    want = {k: (v["n_txn"], v["n_distinct_senders"], v["n_distinct_receivers"]) for k, v in day_stats(make(spark, random_rows(7))).items()}
    assert {k: v for k, v in got.items() if k[1] < "2024-01-12"} == want
