"""Account-day statistics, rule firing, alerts and threshold calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ranks import running

#: Band just under the reporting threshold, pass-through ratio, unit of round amounts.
BAND, RATIO, ROUND_UNIT = (9000.0, 10000.0), (0.8, 1.25), 1000.0
#: Rules, in order, with their statistic and floor.
RULES = {
    "R01_LARGE_SINGLE_TXN": ("max_txn_usd", 10000.0), "R02_PEER_VOLUME_OUTLIER": ("volume_usd", 10000.0), "R03_STRUCTURING": ("n_near_threshold", 2.0),
    "R04_FAN_IN": ("n_distinct_senders", 5.0), "R05_FAN_OUT": ("n_distinct_receivers", 5.0), "R06_RAPID_IN_OUT": ("pass_through_usd", 5000.0),
    "R07_HIGH_RISK_CHANNEL": ("high_risk_channel_usd", 10000.0), "R08_CROSS_CURRENCY_CHURN": ("n_cross_currency", 3.0), "R09_ROUND_AMOUNTS": ("n_round_amounts", 3.0),
}
STATS = ["max_txn_usd", "volume_usd", "n_near_threshold", "n_distinct_senders", "n_distinct_receivers", "pass_through_usd", "high_risk_channel_usd", "n_cross_currency", "n_round_amounts", "n_txn", "in_usd", "out_usd"]


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _sum(condition: Column, value: str = "usd") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0.0))


def is_round(amount: str = "amount", unit: float = ROUND_UNIT) -> Column:
    a = F.col(amount)
    return (a >= unit) & (F.abs(F.round(a / unit) * unit - a) < 1e-6)


def account_day_stats(legs: DataFrame, keys: tuple[str, ...] = ("account_key", "window_start")) -> DataFrame:
    """Twelve statistics of every account and day, for all days in one aggregation.

    Distinct counterparties are counted after a first aggregation per counterparty, so no row is expanded per distinct.
    """
    incoming, outgoing = F.col("direction") == "in", F.col("direction") == "out"
    per_pair = legs.groupBy(*keys, "counterparty").agg(
        F.count(F.lit(1)).alias("n"), F.max("usd").alias("top"), F.sum("usd").alias("total"), _count((F.col("usd") >= BAND[0]) & (F.col("usd") < BAND[1])).alias("near"),
        _sum(incoming).alias("in_usd"), _sum(outgoing).alias("out_usd"), F.max(incoming).alias("sends"), F.max(outgoing).alias("receives"),
        F.min(F.when(incoming, F.col("ts"))).alias("first_in"), F.max(F.when(outgoing, F.col("ts"))).alias("last_out"), _sum(F.col("high_risk")).alias("risky"),
        _count(F.col("cross")).alias("crossed"), _count(is_round()).alias("rounded"),
    )
    whole = per_pair.groupBy(*keys).agg(
        F.max("top").alias("max_txn_usd"), F.sum("total").alias("volume_usd"), F.sum("near").alias("n_near_threshold"), _count(F.col("sends")).alias("n_distinct_senders"),
        _count(F.col("receives")).alias("n_distinct_receivers"), F.sum("risky").alias("high_risk_channel_usd"), F.sum("crossed").alias("n_cross_currency"), F.sum("rounded").alias("n_round_amounts"),
        F.sum("n").alias("n_txn"), F.sum("in_usd").alias("in_usd"), F.sum("out_usd").alias("out_usd"), F.min("first_in").alias("first_in"), F.max("last_out").alias("last_out"),
    )
    ratio = F.try_divide("out_usd", "in_usd")
    through = (F.col("in_usd") > 0) & (F.col("out_usd") > 0) & ratio.between(*RATIO) & (F.col("last_out") > F.col("first_in"))
    return whole.withColumn("pass_through_usd", F.when(through, F.least("in_usd", "out_usd")).otherwise(0.0)).select(*keys, *STATS)


def fire(stats: DataFrame, thresholds: dict[str, float | dict] | None = None) -> DataFrame:
    """``fired_*`` flags, the fired rules in order, and their number.  A threshold may be ``{peer: value, None: default}``."""
    used = thresholds or {rule: floor for rule, (_, floor) in RULES.items()}
    unknown = set(used) - set(RULES)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")

    fired = {f"fired_{rule}": fires(rule, v) for rule, v in used.items()}
    out = stats.withColumns(fired)
    out = out.withColumn("triggered_rules", F.array_compact(F.array(*[F.when(F.col(f"fired_{rule}"), rule) for rule in used])))
    return out.withColumn("n_rules_triggered", F.size("triggered_rules").cast("long"))


def alerts(fired: DataFrame, variant: str = "main") -> DataFrame:
    """Fired account-days with their window's end, moment of creation and keyed id."""
    from ledgerloom.functions.hashing import keyed_hex

    rows = fired.filter("n_rules_triggered > 0").withColumns({"window_end": F.expr("window_start + interval 1 day - interval 1 second"), "as_of": F.expr("window_start + interval 1 day"), "created_at": F.expr("window_start + interval 1 day")})
    name = F.concat_ws("|", F.lit(variant), "account_key", F.date_format("window_start", "yyyy-MM-dd"))
    return rows.withColumn("alert_id", F.concat(F.lit("A"), keyed_hex("alert_id", 0, 16)(name)))


def higher_quantiles(stats: DataFrame, columns: list[str], taus: list[float]) -> DataFrame:
    """``stat, tau, threshold``: the value at rank ``ceil(tau (n - 1)) + 1``, never under the rule's floor.

    All statistics are ranked in one pass over a long form; equal values are counted first, then dealt into ranges.
    """
    long = stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("value")) for c in columns])).alias("s")).select("s.*")
    counts = long.groupBy("stat", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts, "value", {"upto": "n"}, "stat").withColumnRenamed("all_upto", "total")
    grid = ranked.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus]))).withColumn("rank", F.ceil(F.col("tau") * (F.col("total") - 1)) + 1)
    floors = {stat: floor for stat, floor in RULES.values()}
    hit = grid.filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    floor = F.create_map(*[x for k, v in floors.items() for x in (F.lit(k), F.lit(v))])
    return hit.select("stat", "tau", F.greatest("value", F.coalesce(floor[F.col("stat")], F.lit(0.0))).alias("threshold"))


def peer_thresholds(stats: DataFrame, stat: str, tau: float, peer: str, least_rows: int) -> DataFrame:
    """``peer_group, threshold``; a group of fewer than ``least_rows`` takes the threshold of all rows."""
    counts = stats.groupBy(F.col(peer).alias("peer_group"), F.col(stat).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    rank = F.ceil(F.lit(tau) * (F.col("all_upto") - 1)) + 1
    groups = running(counts, "value", {"upto": "c"}, "peer_group").filter((rank <= F.col("upto")) & (rank > F.col("upto") - F.col("c"))).withColumnRenamed("all_upto", "n")
    overall = higher_quantiles(stats.select(F.col(stat)), [stat], [tau]).first()  # one row
    floor = next((f for s, f in RULES.values() if s == stat), 0.0)
    value = F.when(F.col("n") >= least_rows, F.greatest("value", F.lit(floor))).otherwise(F.lit(overall["threshold"] if overall else None).cast("double"))
    return groups.select("peer_group", F.col("n").alias("n_rows"), value.alias("threshold"))


def threshold_grid(stats: DataFrame, taus: list[float], peer: str | None = None, peer_rule: str = "R02_PEER_VOLUME_OUTLIER", least_peer_rows: int = 1000) -> dict[tuple[str, float], float | dict]:
    """The threshold of every rule at every tau; with ``peer``, one rule's are by peer group, with a default."""
    stat_of = {rule: stat for rule, (stat, _) in RULES.items()}
    found: dict[tuple[str, float], float | dict] = {}
    for row in higher_quantiles(stats, sorted(set(stat_of.values())), taus).collect():
        found |= {(rule, row["tau"]): row["threshold"] for rule, stat in stat_of.items() if stat == row["stat"]}
    if peer is not None:
        for tau in taus:
            groups = peer_thresholds(stats, stat_of[peer_rule], tau, peer, least_peer_rows).filter(F.col("n_rows") >= least_peer_rows).collect()
            found[peer_rule, tau] = {r["peer_group"]: r["threshold"] for r in groups} | {None: found[peer_rule, tau]}
    return found


def fires(rule: str, threshold: float | dict) -> Column:
    """Whether a rule fires: its statistic is above 0 and reaches the threshold of the row's peer group."""
    value = F.col(RULES[rule][0])
    if not isinstance(threshold, dict):
        return (value > 0) & (value >= F.lit(float(threshold)))
    peers = [x for k, v in threshold.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
    limit = F.coalesce(F.create_map(*peers)[F.col("peer_group")], F.lit(float(threshold[None]))) if peers else F.lit(float(threshold[None]))
    return (value > 0) & (value >= limit)


def calibrate(stats: DataFrame, taus: list[float], *, n_positive: int, method: str = "per_rule", band: tuple[float, float] = (0.02, 0.10), target: float = 0.05, least_precision: float = 0.02, least_true: int = 10, too_strong: tuple[float, float] = (0.25, 0.05), most_recall: float = 0.95, least_rules: int = 6, peer: str | None = None, least_peer_rows: int = 1000) -> dict:
    """Thresholds learned from account-day statistics with ``is_pos``; ``taus`` run from strict to loose.

    ``global``: one tau for all rules, whose alerts' precision is inside ``band`` and nearest to ``target`` (ratio, then the
    higher recall).  ``per_rule``: each rule's loosest tau at which the rule alone reaches ``least_precision`` with
    ``least_true`` true alerts; a rule without one is dropped.  A rule above both bounds of ``too_strong`` (precision, recall)
    is loosened step by step, then dropped.  The whole layer must have its precision in ``band``, its recall below
    ``most_recall`` and ``least_rules`` rules, else this raises.

    Every rule and tau is counted in one aggregation; only those counts and the thresholds reach the driver.
    """
    if list(taus) != sorted(taus, reverse=True):
        raise ValueError("taus run from strict to loose")
    if method not in ("global", "per_rule"):
        raise ValueError(f"unknown method {method}")
    rules, grid = list(RULES), threshold_grid(stats, taus, peer, least_peer_rows=least_peer_rows)
    cells = [(r, t) for r in rules for t in taus]

    def counted(condition: Column, name: str) -> list[Column]:
        return [F.count(F.when(condition, 1)).alias(f"n_{name}"), F.count(F.when(condition & F.col("is_pos"), 1)).alias(f"p_{name}")]

    def any_of(chosen: dict[str, float]) -> Column:
        fired = [fires(r, grid[r, t]) for r, t in chosen.items()]
        return F.greatest(F.lit(False), F.lit(False), *fired) if fired else F.lit(False)

    each = [c for i, (r, t) in enumerate(cells) for c in counted(fires(r, grid[r, t]), f"{i}")]
    layers = [c for i, t in enumerate(taus) for c in counted(any_of(dict.fromkeys(rules, t)), f"all{i}")] if method == "global" else []
    row = stats.agg(*each, *layers).first()
    measured = {cell: (row[f"n_{i}"], row[f"p_{i}"]) for i, cell in enumerate(cells)}

    def precision(n: int, p: int) -> float | None:
        return p / n if n else None

    def recall(p: int) -> float | None:
        return p / n_positive if n_positive else None

    chosen: dict[str, float] = {}
    actions: list[dict] = []
    if method == "global":
        layer = {t: (row[f"n_all{i}"], row[f"p_all{i}"]) for i, t in enumerate(taus)}
        inside = [t for t in taus if (x := precision(*layer[t])) is not None and band[0] <= x <= band[1]]
        if not inside:
            raise ValueError(f"no tau has a precision between {band[0]} and {band[1]}: {layer}")
        best = min(inside, key=lambda t: (abs(math.log(precision(*layer[t]) / target)), -(recall(layer[t][1]) or 0)))
        chosen = dict.fromkeys(rules, best)
    else:
        for r in rules:
            good = [t for t in taus if (x := precision(*measured[r, t])) is not None and x >= least_precision and measured[r, t][1] >= least_true]
            if good:
                chosen[r] = good[-1]
            actions.append({"rule": r, "action": "select", "tau": good[-1]} if good else {"rule": r, "action": "drop"})
    for r in [r for r in rules if r in chosen]:
        while r in chosen and (precision(*measured[r, chosen[r]]) or 0) > too_strong[0] and (recall(measured[r, chosen[r]][1]) or 0) > too_strong[1]:
            at = taus.index(chosen[r])
            if at + 1 < len(taus):
                actions.append({"rule": r, "action": "loosen", "tau": taus[at + 1]})
                chosen[r] = taus[at + 1]
            else:
                actions.append({"rule": r, "action": "drop_too_strong"})
                del chosen[r]
    whole = stats.agg(*counted(any_of(chosen), "whole")).first()
    found, caught = precision(whole["n_whole"], whole["p_whole"]), recall(whole["p_whole"])
    problems = [f"precision {found}"] * (found is None or not band[0] <= found <= band[1]) + [f"recall {caught}"] * (caught is not None and caught >= most_recall) + [f"{len(chosen)} rules"] * (len(chosen) < least_rules)
    if problems:
        raise ValueError(f"the calibrated layer is out of bounds: {', '.join(problems)}; {actions}")
    return {"taus": chosen, "thresholds": {r: grid[r, t] for r, t in chosen.items()}, "actions": actions, "n_alerts": whole["n_whole"], "n_true": whole["p_whole"], "measured": {r: measured[r, t] for r, t in chosen.items()}}


def rule_evaluation(fired: DataFrame, n_positive: int) -> DataFrame:
    """``rule, n_alerts, n_true, precision, recall, n_only, n_true_only`` of every rule and of ``ALL``; one aggregation.

    ``fired`` has ``is_pos``; ``n_only`` counts the alerts that no other rule raises (for ``ALL``, alerts of one rule).
    """
    names = [c for c in fired.columns if c.startswith("fired_")]
    only = F.col("n_rules_triggered") == 1
    cells = [F.struct(F.lit(c.removeprefix("fired_")).alias("rule"), F.col(c).alias("on")) for c in names] + [F.struct(F.lit("ALL").alias("rule"), (F.col("n_rules_triggered") > 0).alias("on"))]
    long = fired.select("is_pos", only.alias("only"), F.explode(F.array(*cells)).alias("c")).select("is_pos", "only", "c.*")
    counts = long.groupBy("rule").agg(*[_count(F.col("on") & c).alias(n) for n, c in (("n_alerts", F.lit(True)), ("n_true", F.col("is_pos")), ("n_only", F.col("only")), ("n_true_only", F.col("only") & F.col("is_pos")))])
    return counts.select("rule", "n_alerts", "n_true", F.round(F.try_divide("n_true", "n_alerts"), 9).alias("precision"), F.round(F.try_divide(F.col("n_true"), F.lit(n_positive)), 9).alias("recall"), "n_only", "n_true_only")


def rules_histogram(fired: DataFrame) -> DataFrame:
    """How many alerts fire one rule, two rules, and so on."""
    return fired.filter("n_rules_triggered > 0").groupBy("n_rules_triggered").agg(F.count(F.lit(1)).alias("n"))


def rule_overlap(fired: DataFrame) -> DataFrame:
    """``a, b, n_a, n_both, share``: how often rule b fires where rule a does; one aggregation, no self-join."""
    names = [c.removeprefix("fired_") for c in fired.columns if c.startswith("fired_")]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"fired_{b}").alias("both")) for a in names for b in names]
    rows = fired.select(F.explode(F.array(*[F.when(F.col(f"fired_{names[i // len(names)]}"), c) for i, c in enumerate(cells)])).alias("c")).filter("c IS NOT NULL").select("c.*")
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_a"), F.count(F.when(F.col("both"), 1)).alias("n_both")).withColumn("share", F.round(F.col("n_both") / F.col("n_a"), 6))


def rank_of(tau: float, n: int) -> int:
    """Rank, from 1, of the 'higher' quantile among n values."""
    return math.ceil(tau * (n - 1)) + 1
