"""Choosing and comparing models: search space, category codes, paired gains, ceilings, importance and learning curves.

Evaluation rows travel with the bootstrap's tasks, as in ``metrics``: their number is checked first.  Ceilings of more
rows draw them where they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.hashing import keyed_uniform
from ledgerloom.functions.lineage import checkpointed
from ledgerloom.operators.metrics import auc_ap, spread_ap, tied_auc_ap

AUC, AP = 0, 1
BUCKET_ROWS = 100_000


def search_space(families: dict[str, dict[str, list]]) -> list[dict]:
    """Every combination of each family's listed parameters, in order; a family without parameters is one configuration."""
    found = []
    for family, grid in families.items():
        for values in itertools.product(*grid.values()):
            found.append({"id": "_".join([family, *(f"{k}={v}" for k, v in zip(grid, values))]), "family": family, "params": dict(zip(grid, values))})
    if len({c["id"] for c in found}) != len(found):
        raise ValueError("a configuration is listed twice")
    return found


def category_codes(fit: DataFrame, rows: DataFrame, columns: list[str], most: int = 250) -> DataFrame:
    """``rows`` with a ``code_`` column for each category: its place among the sorted categories of ``fit``, NaN if unknown there.

    More than ``most`` categories raise; no more than that are brought to the driver.
    """
    out = rows
    for c in columns:
        found = [r[0] for r in fit.select(c).filter(F.col(c).isNotNull()).distinct().limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"{c} has more than {most} categories")
        code = F.create_map(*[x for i, v in enumerate(sorted(found)) for x in (F.lit(v), F.lit(float(i)))])[F.col(c)] if found else F.lit(None).cast("double")
        out = out.withColumn(f"code_{c}", F.coalesce(code, F.lit(float("nan"))))
    return out


def _checked(rows: DataFrame, columns: list[str], order: list[str], most_rows: int):
    n = rows.count()
    if n > most_rows:
        raise ValueError(f"{n} evaluation rows are more than a task may hold ({most_rows})")
    return rows.select(*columns).toPandas().sort_values(order).reset_index(drop=True)


def pooled_metric(folds: list[tuple[np.ndarray, np.ndarray, np.ndarray]], which: int = AUC) -> float:
    """Mean of a metric over (score, y, weight) folds, weighted by their positives; folds without a value are left out."""
    found = [(tied_auc_ap(s, y, w)[which], float((y * w).sum())) for s, y, w in folds if w.sum() > 0]
    found = [(v, p) for v, p in found if v == v and p > 0]
    return sum(v * p for v, p in found) / sum(p for _, p in found) if found else float("nan")


def paired_gain(rows: DataFrame, score: str, baseline: str, fold: str, key: str, which: int = AUC, replicates: int = 200, seed: int = 0, most_rows: int = 1_000_000) -> DataFrame:
    """``replicate, gain``: pooled metric of a score less that of a baseline; replicate -1 is the sample itself.

    Rows are drawn within their fold, the same ones for both scores.
    """
    import pandas as pd

    data = _checked(rows, [F.col(fold).cast("string").alias("f"), F.col(key).cast("string").alias("k"), F.col(score).cast("double").alias("a"), F.col(baseline).cast("double").alias("b"), F.col("y").cast("double").alias("y")], ["f", "k", "a", "b", "y"], most_rows)
    parts = [(g["a"].to_numpy(), g["b"].to_numpy(), g["y"].to_numpy()) for _, g in data.groupby("f")]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch["replicate"]:
                draw = np.random.default_rng([seed, int(r) + 1])
                weights = [np.ones(len(y)) if r < 0 else draw.multinomial(len(y), np.full(len(y), 1 / len(y))).astype(float) for _, _, y in parts]
                out.append((int(r), pooled_metric([(a, y, w) for (a, _, y), w in zip(parts, weights)], which) - pooled_metric([(b, y, w) for (_, b, y), w in zip(parts, weights)], which)))
            yield pd.DataFrame(out, columns=["replicate", "gain"])

    return rows.sparkSession.range(-1, replicates).withColumnRenamed("id", "replicate").mapInPandas(run, "replicate long, gain double")


def comparison(rows: DataFrame, gains: DataFrame, material: float, least_positive: int, level: float = 0.95, most_undefined: float = 0.01) -> dict:
    """Gain, its interval and a verdict: ``signal``, ``no_signal``, ``inconclusive``, or ``insufficient_data``."""
    half = (1 - level) / 2
    drawn, defined = F.col("replicate") >= 0, ~F.isnan("gain")
    s = gains.agg(F.max(F.when(F.col("replicate") < 0, F.col("gain"))).alias("gain"), F.percentile(F.when(drawn & defined, F.col("gain")), F.lit(half)).alias("low"), F.percentile(F.when(drawn & defined, F.col("gain")), F.lit(1 - half)).alias("high"), F.count(F.when(drawn & ~defined, 1)).alias("undefined"), F.count(F.when(drawn, 1)).alias("n")).first()
    positive = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()["p"]
    return {"gain": s["gain"], "low": s["low"], "high": s["high"], "n_positive": int(positive), "verdict": "insufficient_data" if positive < least_positive or s["undefined"] > most_undefined * s["n"] else gain_verdict(s["low"], s["high"], material)}


def gain_verdict(low: float | None, high: float | None, material: float) -> str:
    if low is None or high is None:
        return "insufficient_data"
    return "signal" if low >= material else "no_signal" if high < material else "inconclusive"


def simplest_wins(order: list[str], metric: dict[str, float], lows: dict[str, float | None]) -> str:
    """The first of ``order``, unless others beat it with a gain whose lower bound is above 0: then the best of those, ties to the earlier."""
    passing = [c for c in order[1:] if lows.get(c) is not None and lows[c] > 0]
    return max(passing, key=lambda c: (metric[c], -order.index(c))) if passing else order[0]


def ceilings(rows: DataFrame, checks: dict[str, tuple[str, str | None, float]], key: str, replicates: int = 200, seed: int = 0, level: float = 0.95, least_positive: int = 20, most_rows: int = 1_000_000) -> DataFrame:
    """``check, value, ceiling, low, high, passes``: average precision of a score, less that of a baseline if one is named.

    ``checks``: name -> (score, baseline, multiple); a value must not be over ``multiple`` times the prevalence.  With
    fewer than ``least_positive`` positives there are no rows.  Up to ``most_rows`` rows travel with the tasks; more are
    resampled where they are, by ``spread_ap``.
    """
    import pandas as pd

    schema = "check string, value double, ceiling double, low double, high double, passes boolean"
    names = sorted({c for a, b, _ in checks.values() for c in (a, b) if c})
    columns, spark, half = [F.col(key).cast("string").alias("__k"), F.col("y").cast("double").alias("__y"), *[F.col(c).cast("double") for c in names]], rows.sparkSession, (1 - level) / 2
    rows = checkpointed(rows.select(*columns))
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("__y"), F.lit(0.0))).first()
    if positive < least_positive:
        return spark.createDataFrame([], schema)
    if n > most_rows:
        ap = spread_ap(rows, "__k", names, replicates, seed, "__y").groupBy("replicate").pivot("score", names).agg(F.first("ap"))
        value = [F.struct(F.lit(c).alias("check"), (F.col(a) - F.col(b) if b else F.col(a)).alias("v")) for c, (a, b, _) in checks.items()]
        found = checkpointed(ap.select("replicate", F.explode(F.array(*value)).alias("s")).select("replicate", "s.*"))
        drawn = found.filter("replicate >= 0")
        whole = {r["check"]: r["v"] for r in found.filter("replicate < 0").collect()}
        whole = [whole[c] for c in checks]
    else:
        data = _checked(rows, ["*"], ["__k", "__y", *names], most_rows)
        y = data["__y"].to_numpy()
        scores = {c: data[c].to_numpy() for c in names}

        def values(weight: np.ndarray) -> list[float]:
            ap = {c: tied_auc_ap(s, y, weight)[AP] for c, s in scores.items()}
            return [ap[a] - (ap[b] if b else 0.0) for a, b, _ in checks.values()]

        def run(batches):
            for batch in batches:
                out = []
                for r in batch["replicate"]:
                    weight = np.random.default_rng([seed, int(r)]).multinomial(len(y), np.full(len(y), 1 / len(y))).astype(float)
                    out += [(n, v) for n, v in zip(checks, values(weight))]
                yield pd.DataFrame(out, columns=["check", "v"])

        drawn = spark.range(replicates).withColumnRenamed("id", "replicate").mapInPandas(run, "check string, v double")
        whole = values(np.ones(len(y)))
    spread = drawn.filter(~F.isnan("v")).groupBy("check").agg(F.percentile("v", F.lit(half)).alias("low"), F.percentile("v", F.lit(1 - half)).alias("high"))
    limits = spark.createDataFrame([(c, float(v), float(m * positive / n), bool(v <= m * positive / n)) for (c, (_, _, m)), v in zip(checks.items(), whole)], "check string, value double, ceiling double, passes boolean")
    return limits.join(F.broadcast(spread), "check", "left").select("check", "value", "ceiling", "low", "high", "passes")


def permutation_importance(rows: DataFrame, features: list[str], score: Callable[[DataFrame], DataFrame], key: str, repeats: int = 3, seed: int = 0) -> DataFrame:
    """``feature, mean_drop``: loss of average precision if a feature's values are dealt anew among the rows.

    Values are dealt inside buckets of about ``BUCKET_ROWS`` rows, drawn by a hash of the unique ``key``, by joining the
    rows' numbers in two keyed orders; ``score`` adds a ``score`` column.
    """
    from pyspark.sql import Window

    spark, rows = rows.sparkSession, checkpointed(rows)
    whole = auc_ap(score(rows), "score", "y").first()
    base, bucket = whole["ap"], F.pmod(F.xxhash64(key), F.lit(max(1, whole["n"] // BUCKET_ROWS)))
    if base is None:
        return spark.createDataFrame([(f, None) for f in features], "feature string, mean_drop double")
    found = []
    for f in features:
        drops = []
        for r in range(repeats):
            u = keyed_uniform("importance", seed, f"{f}|{r}")(F.col(key).cast("string"))
            marked = rows.withColumns({"__b": bucket, "__u": u})
            own = marked.withColumn("__at", F.row_number().over(Window.partitionBy("__b").orderBy(key)))
            other = marked.select("__b", F.row_number().over(Window.partitionBy("__b").orderBy("__u", key)).alias("__at"), F.col(f).alias("__dealt"))
            dealt = own.join(other, ["__b", "__at"]).withColumn(f, F.col("__dealt")).drop("__b", "__u", "__at", "__dealt")
            drops.append(base - auc_ap(score(dealt), "score", "y").first()["ap"])
        found.append((f, float(np.mean(drops))))
    return spark.createDataFrame(sorted(found, key=lambda x: -x[1]), "feature string, mean_drop double")


def learning_curve(fit: DataFrame, check: DataFrame, fractions: list[float], key: str, build: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], seed: int = 0) -> DataFrame:
    """``fraction, n_fit, ap_fit, ap_check`` of models that learn from growing keyed shares of ``fit``; larger shares hold the smaller ones."""
    check = checkpointed(check)
    drawn = checkpointed(fit.withColumn("__u", keyed_uniform("learning_curve", seed, "share")(F.col(key).cast("string"))))
    found = []
    for fraction in fractions:
        part = drawn.filter(F.col("__u") < fraction).drop("__u")
        n, p = part.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
        if p in (0, n):
            found.append((float(fraction), n, None, None))
            continue
        score = build(part)
        found.append((float(fraction), n, auc_ap(score(part), "score", "y").first()["ap"], auc_ap(score(check), "score", "y").first()["ap"]))
    return fit.sparkSession.createDataFrame(found, "fraction double, n_fit long, ap_fit double, ap_check double")


def ablation(fit: DataFrame, check: DataFrame, sets: dict[str, list[str]], kind: str = "trees", **options) -> DataFrame:
    """``features, ap, times_prevalence`` on ``check`` of a model for each named set of columns."""
    from ledgerloom.operators.models import fit_model, positive_score

    fit, check, found = checkpointed(fit), checkpointed(check), []
    for name, columns in sets.items():
        r = auc_ap(positive_score(fit_model(kind, fit, columns, **options), check), "score", "y").first()
        found.append((name, r["ap"], None if r["ap"] is None else round(r["ap"] * r["n"] / r["n_pos"], 6)))
    return fit.sparkSession.createDataFrame(found, "features string, ap double, times_prevalence double")
