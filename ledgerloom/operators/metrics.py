"""Metrics with exact ties: AUC, average precision, operating points, bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.hashing import mixed
from ledgerloom.functions.lineage import checkpointed
from ledgerloom.operators.ranks import running


def by_score(rows: DataFrame, score: str = "score", y: str = "y", *by: str) -> DataFrame:
    """One row per distinct score, with positives, rows and their running sums from the top.

    The aggregation comes first; distinct scores are then dealt into ranges, so no task sees all of them.
    """
    grouped = rows.groupBy(*by, score).agg(F.sum(y).cast("long").alias("pos"), F.count(F.lit(1)).alias("n"))
    return running(grouped, score, {"tp": "pos", "flagged": "n"}, *by, descending=True).withColumnsRenamed({"all_tp": "all_pos", "all_flagged": "all_n"})


def auc_ap(rows: DataFrame, score: str = "score", y: str = "y", *by: str) -> DataFrame:
    """``n, n_pos, auc, ap``: ties count half in the AUC and are one step in the average precision."""
    s = by_score(rows, score, y, *by)
    neg = F.col("n") - F.col("pos")
    wins = neg * (F.col("tp") - F.col("pos") + F.col("pos") / F.lit(2.0))
    return s.groupBy(*by).agg(F.max("all_n").alias("n"), F.max("all_pos").alias("n_pos"), F.round(F.try_divide(F.sum(wins), F.max("all_pos") * (F.max("all_n") - F.max("all_pos"))), 9).alias("auc"), F.round(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("flagged")), F.max("all_pos")), 9).alias("ap"))


def cost_threshold(rows: DataFrame, ratio: float, score: str = "score", y: str = "y") -> DataFrame:
    """The score that minimises ``ratio * FN + FP``, or infinity where flagging nothing does; ties flag fewer rows."""
    s = by_score(rows, score, y)
    cost = ratio * (F.col("all_pos") - F.col("tp")) + (F.col("flagged") - F.col("tp"))
    some = s.select(F.col(score).cast("double").alias("threshold"), cost.cast("double").alias("cost"), F.col("flagged").alias("n_flagged"), F.col("tp").alias("n_true"))
    nothing = rows.agg((ratio * F.coalesce(F.sum(y), F.lit(0))).cast("double").alias("cost")).select(F.lit(float("inf")).alias("threshold"), "cost", F.lit(0).cast("long").alias("n_flagged"), F.lit(0).cast("long").alias("n_true"))
    return some.unionByName(nothing).orderBy("cost", "n_flagged").limit(1)


def precision_at_recall(rows: DataFrame, recall: float, score: str = "score", y: str = "y") -> DataFrame:
    s = by_score(rows, score, y).filter(F.col("tp") >= recall * F.col("all_pos"))
    return s.agg(F.round(F.max(F.col("tp") / F.col("flagged")), 9).alias("precision"))


def recall_at_capacity(rows: DataFrame, share: float, score: str = "score", y: str = "y") -> DataFrame:
    """Recall among the top share of rows; a tie at the cut counts in expectation."""
    s = by_score(rows, score, y).withColumn("room", F.ceil(share * F.col("all_n")))
    before = F.col("flagged") - F.col("n")
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("room") - before) / F.col("n")))
    return s.agg(F.round(F.sum(part * F.col("pos")) / F.max("all_pos"), 9).alias("recall"))


def brier(rows: DataFrame, probability: str, y: str = "y") -> DataFrame:
    return rows.agg(F.round(F.avg(F.pow(F.col(probability) - F.col(y), 2)), 9).alias("brier"))


def strata_auc(rows: DataFrame, stratum: str = "strata", fold: str = "fold", score: str = "score", y: str = "y", least_positive: int = 0) -> DataFrame:
    """``stratum, n_pos, share, auc``: a stratum's positives against all negatives of their fold, pooled by positives.

    ``stratum`` is an array of names; a positive counts in each of its strata.  Folds without a negative have no AUC and are
    left out of the pool; fewer than ``least_positive`` positives have none.
    """
    # One pass: wins of each positive over the negatives below it (ties count half), by the scores' running sums.
    negative = F.when(F.col(y) == 0, 1).otherwise(0)
    scores = rows.withColumn("__neg", negative).groupBy(fold, score).agg(F.sum("__neg").alias("neg"))
    ranked = running(scores, score, {"below": "neg"}, fold).select(F.col(fold).alias("f"), F.col(score).alias("s"), (F.col("below") - F.col("neg") / F.lit(2.0)).alias("wins"), F.col("all_below").alias("negatives"))
    positives = rows.filter(F.col(y) == 1).select(F.col(fold).alias("f"), F.col(score).alias("s"), F.explode(stratum).alias("stratum"))
    met = positives.join(ranked, ["f", "s"]).groupBy("stratum", "f").agg(F.count(F.lit(1)).alias("p"), F.try_divide(F.avg("wins"), F.first("negatives")).alias("auc"))
    pooled = met.groupBy("stratum").agg(F.sum("p").alias("n_pos"), F.try_divide(F.sum(F.col("auc") * F.col("p")), F.sum(F.when(F.col("auc").isNotNull(), F.col("p")))).alias("auc"))
    total = rows.agg(F.sum(F.when(F.col(y) == 1, 1)).alias("total")).first()["total"]
    return pooled.select("stratum", "n_pos", F.round(F.col("n_pos") / F.lit(total), 9).alias("share"), F.when(F.col("n_pos") >= least_positive, F.round("auc", 9)).alias("auc"))


def within_alert_auc(legs: DataFrame, alert: str = "alert_id", score: str = "score", y: str = "y") -> DataFrame:
    """``alert, auc``: how an alert's laundering payments rank above its others; alerts of one class have none."""
    found = auc_ap(legs, score, y, alert)
    return found.filter("auc IS NOT NULL").select(alert, "auc")


def univariate_auc(rows: DataFrame, features: list[str], y: str = "y") -> DataFrame:
    """AUC and orientation of many features in one pass over a long form; a missing value ranks lowest."""
    long = rows.select(F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf"))).alias("score")) for f in features])).alias("f")).select("y", "f.*")
    found = auc_ap(long, "score", "y", "feature")
    return found.select("feature", "n", "n_pos", F.greatest("auc", 1 - F.col("auc")).alias("auc"), F.when(F.col("auc") >= 0.5, 1).otherwise(-1).alias("orientation"))


def tied_auc_ap(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    order = np.argsort(-score, kind="stable")
    s, p, w = score[order], (y * weight)[order], weight[order]
    last = np.append(s[1:] != s[:-1], True)
    tp, flagged = np.cumsum(p)[last], np.cumsum(w)[last]
    pos, n = np.diff(tp, prepend=0.0), np.diff(flagged, prepend=0.0)
    if tp[-1] == 0 or tp[-1] == flagged[-1]:
        return float("nan"), float("nan")
    auc = float(np.sum((n - pos) * (tp - pos / 2)) / (tp[-1] * (flagged[-1] - tp[-1])))
    return auc, float(np.sum(pos * np.divide(tp, flagged, out=np.zeros_like(tp), where=flagged > 0)) / tp[-1])


def bootstrap(rows: DataFrame, unit: str, replicates: int = 200, seed: int = 0, score: str = "score", y: str = "y", most_rows: int = 1_000_000) -> DataFrame:
    """``replicate, auc, ap``, resampling units; replicates are spread over tasks, each with the same evaluation rows.

    Up to ``most_rows`` evaluation rows travel with the tasks; more are resampled where they are, by ``spread_bootstrap``.
    """
    n = rows.count()
    if n > most_rows:
        return spread_bootstrap(rows, unit, replicates, seed, score, y)
    data = rows.select(F.col(unit).cast("string").alias("unit"), F.col(score).cast("double").alias("s"), F.col(y).cast("double").alias("y")).toPandas().sort_values(["unit", "s", "y"])
    codes, _ = pd.factorize(data["unit"])
    s, labels, units = data["s"].to_numpy(), data["y"].to_numpy(), int(codes.max()) + 1 if n else 0

    def run(batches):
        for batch in batches:
            found = []
            for r in batch["replicate"]:
                drawn = np.random.default_rng([seed, int(r)]).multinomial(units, np.full(units, 1 / units)).astype(float)
                found.append((int(r), *tied_auc_ap(s, labels, drawn[codes])))
            yield pd.DataFrame(found, columns=["replicate", "auc", "ap"])

    return rows.sparkSession.range(replicates).withColumnRenamed("id", "replicate").mapInPandas(run, "replicate long, auc double, ap double")


def spread_bootstrap(rows: DataFrame, unit: str, replicates: int = 200, seed: int = 0, score: str = "score", y: str = "y") -> DataFrame:
    """``replicate, auc, ap`` of any number of rows: every unit's multiplicity in a replicate is a Poisson draw by a hash.

    The draws of units are independent, so the replicates' sizes vary about the sample's; no task holds all rows.
    """
    bounds, total, term = [], 0.0, math.exp(-1.0)
    for k in range(20):
        total += term
        bounds.append(total)
        term /= k + 1
    u = F.shiftrightunsigned(F.xxhash64(F.col(unit).cast("string"), "replicate", F.lit(seed)), 11) / F.lit(float(1 << 53))
    drawn = rows.select(F.col(unit), F.col(score).cast("double").alias("score"), F.col(y).cast("double").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("replicate"))
    weighted = drawn.withColumn("w", F.size(F.filter(F.lit(bounds), lambda b: u >= b))).filter("w > 0")
    s = weighted.groupBy("replicate", "score").agg(F.sum(F.col("w") * F.col("y")).alias("pos"), F.sum("w").alias("n"))
    s = running(s, "score", {"tp": "pos", "flagged": "n"}, "replicate", descending=True)
    wins = (F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") / F.lit(2.0))
    auc, ap = F.try_divide(F.sum(wins), F.max("all_tp") * (F.max("all_flagged") - F.max("all_tp"))), F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("flagged")), F.max("all_tp"))
    defined = (F.max("all_tp") > 0) & (F.max("all_tp") < F.max("all_flagged"))
    return s.groupBy("replicate").agg(F.when(defined, auc).otherwise(float("nan")).alias("auc"), F.when(defined, ap).otherwise(float("nan")).alias("ap"))


def poisson_draw(hashes: np.ndarray, replicate: int, seed: int = 0) -> np.ndarray:
    """How often each row (a 64-bit hash) is drawn in a replicate: Poisson numbers of mean one; replicate -1 has every row once."""
    if replicate < 0:
        return np.ones(len(hashes))
    u = mixed(hashes ^ mixed(np.array([seed * 1_000_003 + replicate + 1], dtype=np.uint64))[0])
    found, total, term = np.zeros(len(hashes), dtype=np.uint8), 0.0, math.exp(-1.0)
    for k in range(20):
        total += term
        term /= k + 1
        more = u >= np.uint64(min(int(total * 2.0**64), 2**64 - 1))
        if not more.any():
            break
        found += more
    return found.astype(float)


def spread_ap(rows: DataFrame, key: str, scores: list[str], replicates: int = 200, seed: int = 0, y: str = "y", range_rows: int = 50_000, most_ranges: int = 256) -> DataFrame:
    """``replicate, score, ap`` of any number of rows, the same draws for all scores; replicate -1 is the sample itself.

    ``key`` names a row.  Its multiplicity in a replicate is a Poisson draw by a hash, so it can be drawn again wherever
    the row is needed: first each score's ranges are summed up, then every range goes on from the sums above it.  A value
    that fills ranges of its own needs its sums only, so ties are dealt to many tasks.  A missing score ranks lowest.
    """
    from pyspark.sql import Window

    low = float("-inf")
    held = checkpointed(rows.select(F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("h"), F.col(y).cast("double").alias("y"), *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(low)), F.lit(low)).alias(f"s{i}") for i, c in enumerate(scores)]))
    ranges = min(most_ranges, -(-held.count() // range_rows))
    cuts = held.approxQuantile([f"s{i}" for i in range(len(scores))], [k / ranges for k in range(1, ranges)], 0.25 / ranges) if ranges > 1 else [[] for _ in scores]
    bounds = [np.unique(np.array(c)) for c in cuts]
    alone = [np.array([c.count(v) > 1 for v in b] + [False]) for c, b in zip(cuts, bounds)]

    def places(i: int, values: np.ndarray) -> np.ndarray:
        """Numbers of the values' ranges, ascending; odd ones hold a single value."""
        at = np.searchsorted(bounds[i], values)
        return 2 * at + ((np.append(bounds[i], np.nan)[at] == values) & alone[i][at])

    def add(batches):
        total = [np.zeros((2, replicates + 1, 2 * len(b) + 2)) for b in bounds]
        for batch in batches:
            h, labels = batch["h"].to_numpy().view(np.uint64), batch["y"].to_numpy()
            at = [places(i, batch[f"s{i}"].to_numpy()) for i in range(len(scores))]
            some = np.flatnonzero(labels)
            for r in range(-1, replicates):
                w = poisson_draw(h, r, seed)
                for t, a in zip(total, at):
                    t[0, r + 1] += np.bincount(a[some], w[some] * labels[some], minlength=t.shape[2])
                    t[1, r + 1] += np.bincount(a, w, minlength=t.shape[2])
        for i, t in enumerate(total):
            for a in np.flatnonzero(t[1].any(axis=0)):
                yield pd.DataFrame({"i": i, "range": a, "replicate": np.arange(-1, replicates), "pos": t[0, :, a], "n": t[1, :, a]})

    tasks = max(1, ranges)
    by, whole = Window.partitionBy("i", "replicate").orderBy(F.desc("range")), Window.partitionBy("i", "replicate")
    sums = held.repartition(tasks, "h").mapInPandas(add, "i int, range int, replicate long, pos double, n double").groupBy("i", "range", "replicate").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    sums = checkpointed(sums.withColumns({"tp": F.sum("pos").over(by), "flagged": F.sum("n").over(by), "all_pos": F.sum("pos").over(whole), "all_n": F.sum("n").over(whole)}))

    def goes_on(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own, above = own.sort_values("s", ascending=False, kind="stable"), above.sort_values("replicate")
        s, h, labels = own["s"].to_numpy(), own["h"].to_numpy().view(np.uint64), own["y"].to_numpy()
        last, part = np.append(s[1:] != s[:-1], True), []
        for r, tp, flagged in zip(above["replicate"], above["tp"] - above["pos"], above["flagged"] - above["n"]):
            w = poisson_draw(h, r, seed)
            tps, seen = np.cumsum(w * labels)[last] + tp, np.cumsum(w)[last] + flagged
            part.append(float(np.sum(np.diff(tps, prepend=tp) * np.divide(tps, seen, out=np.zeros_like(tps), where=seen > 0))))
        return pd.DataFrame({"i": above["i"], "replicate": above["replicate"], "part": part})

    place = F.pandas_udf(lambda i, s: pd.Series(np.select([i == k for k in range(len(scores))], [places(k, s.to_numpy()) for k in range(len(scores))])), "int")
    long = held.select("h", "y", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"s{i}").alias("s")) for i in range(len(scores))])).alias("v")).select("h", "y", "v.*").withColumn("range", place("i", "s"))
    tasks = tasks * len(scores)
    several, one = "range % 2 = 0", sums.filter("range % 2 = 1")
    parts = long.filter(several).repartition(tasks, "i", "range").groupBy("i", "range").cogroup(sums.filter(several).repartition(tasks, "i", "range").groupBy("i", "range")).applyInPandas(goes_on, "i int, replicate long, part double")
    parts = parts.unionByName(one.select("i", "replicate", F.coalesce(F.try_divide(F.col("pos") * F.col("tp"), F.col("flagged")), F.lit(0.0)).alias("part")))
    ends = sums.groupBy("i", "replicate").agg(F.max("all_pos").alias("p"), F.max("all_n").alias("n"))
    ap = F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), F.col("part") / F.col("p")).otherwise(float("nan"))
    found = parts.groupBy("i", "replicate").agg(F.sum("part").alias("part")).join(ends, ["i", "replicate"])
    return found.select("replicate", F.element_at(F.array(*[F.lit(c) for c in scores]), F.col("i") + 1).alias("score"), ap.alias("ap"))


def interval(replicates: DataFrame, column: str = "ap", level: float = 0.95) -> DataFrame:
    half = (1 - level) / 2
    return replicates.filter(~F.isnan(column)).agg(F.percentile(column, F.lit(half)).alias("low"), F.percentile(column, F.lit(1 - half)).alias("high"), F.count(F.lit(1)).alias("n"))


def permutation_p(observed: float, null: list[float]) -> float:
    """Share of permuted statistics that reach the observed one, itself counted."""
    return (1 + sum(x >= observed for x in null)) / (1 + len(null))
