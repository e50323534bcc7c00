"""Scores: rule counts, smoothed rule weights, logistic regression, trees, and a content-hashed store."""

from __future__ import annotations

import hashlib
import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.files import read_text, write_text


def rule_count(fired: DataFrame) -> DataFrame:
    names = [c for c in fired.columns if c.startswith("fired_")]
    return fired.withColumn("score", sum((F.col(c).cast("double") for c in names), F.lit(0.0)))


def rule_weights(rows: DataFrame, y: str = "y", smoothing: float = 1.0) -> dict[str, float]:
    """Log of smoothed precision over smoothed prevalence for every rule; one aggregation."""
    names = [c for c in rows.columns if c.startswith("fired_")]
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("p"), *[F.sum(F.col(c).cast("int")).alias(f"n_{c}") for c in names], *[F.sum(F.when(F.col(c), F.col(y)).otherwise(0)).alias(f"p_{c}") for c in names]).first()
    n, p = counts["n"], counts["p"] or 0
    base = (p + smoothing) / (n + 2 * smoothing)
    return {c: math.log(((counts[f"p_{c}"] or 0) + smoothing) / ((counts[f"n_{c}"] or 0) + 2 * smoothing) / base) for c in names}


def weighted_score(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    return rows.withColumn("score", sum((F.when(F.col(c), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0)))


def signed_log(x: str) -> Column:
    return F.signum(x) * F.log1p(F.abs(F.col(x)))


def standardised(fit: DataFrame, rows: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Signed logs, centred and scaled on ``fit``; a missing value is 0 with a flag of its own."""
    finite = {f: F.when(~F.isnan(f) & F.col(f).isNotNull(), signed_log(f)) for f in features}
    m = fit.agg(*[F.avg(v).alias(f"m_{f}") for f, v in finite.items()], *[F.stddev_pop(v).alias(f"s_{f}") for f, v in finite.items()]).first()
    scale = {f: s if (s := m[f"s_{f}"] or 0.0) > 1e-9 else None for f in features}  # a constant column tells nothing: 0
    out = rows.withColumns({f"z_{f}": F.lit(0.0) if s is None else F.coalesce((finite[f] - F.lit(m[f"m_{f}"])) / F.lit(s), F.lit(0.0)) for f, s in scale.items()})
    return out.withColumns({f"missing_{f}": F.when(F.isnan(f) | F.col(f).isNull(), 1.0).otherwise(0.0) for f in features}), [f"{k}_{f}" for k in ("z", "missing") for f in features]


def fit_model(kind: str, rows: DataFrame, features: list[str], y: str = "y", **options):
    """``logistic``, ``trees`` (boosted) or ``tree`` on numeric columns; returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    made = {"logistic": LogisticRegression, "trees": GBTClassifier, "tree": DecisionTreeClassifier}
    if kind not in made:
        raise ValueError(f"unknown kind of model: {kind}")
    fixed = {"logistic": {"standardization": False, "regParam": 0.01}, "trees": {"maxIter": 20, "maxDepth": 3, "seed": 0}, "tree": {"maxDepth": 3, "seed": 0}}[kind]
    estimator = made[kind](featuresCol="features", labelCol=y, **{**fixed, **options})
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), estimator]).fit(rows)


def boosted_with_early_stopping(fit: DataFrame, later: DataFrame, features: list[str], y: str = "y", most_trees: int = 60, depth: int = 3, seed: int = 0):
    """Boosted trees, refitted with the number of trees that has the highest average precision on ``later`` rows (the fewest of
    equal ones)."""
    from ledgerloom.operators.metrics import auc_ap

    model = fit_model("trees", fit, features, y, maxIter=most_trees, maxDepth=depth, seed=seed)
    curve = auc_ap(prefix_margins(model, later).select(F.col(y).alias("y"), "trees", F.round("score", 12).alias("score")), "score", "y", "trees")
    best = curve.orderBy(F.col("ap").desc_nulls_last(), "trees").first()
    return fit_model("trees", fit, features, y, maxIter=best["trees"] if best and best["ap"] is not None else most_trees, maxDepth=depth, seed=seed)


def prefix_margins(model, rows: DataFrame) -> DataFrame:
    """``trees, score`` for every row and every number of first trees: the sum of their weighted answers, in one pass."""
    forest, ready = model.stages[-1], model.stages[0].transform(rows)
    for i, tree in enumerate(forest.trees):
        ready = tree.setFeaturesCol("features").setPredictionCol(f"tree_{i}").transform(ready)
    answers = F.array(*[F.col(f"tree_{i}") * F.lit(float(w)) for i, w in enumerate(forest.treeWeights)])
    sums = F.aggregate("answers", F.array().cast("array<double>"), lambda done, x: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)) + x)))
    return ready.withColumn("answers", answers).select(*rows.columns, F.posexplode(F.when(F.size("answers") > 0, sums)).alias("at", "score")).withColumn("trees", F.col("at") + 1).drop("at")


def one_hot(rows: DataFrame, columns: list[str], most: int = 250) -> tuple[DataFrame, list[str]]:
    """A 0/1 column for every category of every column, and their names; more than ``most`` categories raise."""
    made: dict[str, Column] = {}
    for c in columns:
        found = sorted(r[0] for r in rows.select(c).filter(F.col(c).isNotNull()).distinct().limit(most + 1).collect())
        if len(found) > most:
            raise ValueError(f"{c} has more than {most} categories")
        made |= {f"{c}={v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for v in found}
    return rows.withColumns(made), list(made)


def tree_summaries(rows: DataFrame, features: list[str], depths: list[int], y: str = "y") -> DataFrame:
    """``depth, auc, ap, tree``: single trees of several depths, how they rank, and their rules with the features' names."""
    from ledgerloom.operators.metrics import auc_ap

    found = []
    for depth in depths:
        named = rows.withColumnsRenamed({f: f"f{i}" for i, f in enumerate(features)})
        model = fit_model("tree", named, [f"f{i}" for i in range(len(features))], y, maxDepth=depth)
        r = auc_ap(positive_score(model, named).select(F.col(y).alias("y"), F.round("score", 12).alias("score"))).first()
        text = re.sub(r"feature (\d+)", lambda m: features[int(m[1])], model.stages[-1].toDebugString)
        found.append((depth, r["auc"], r["ap"], text.split("\n", 1)[1]))
    return rows.sparkSession.createDataFrame(found, "depth int, auc double, ap double, tree string")


def positive_score(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def contributions(rows: DataFrame, features: list[str], coefficients: list[float]) -> DataFrame:
    """Additive parts of a linear margin."""
    return rows.withColumns({f"part_{f}": F.col(f) * F.lit(float(c)) for f, c in zip(features, coefficients)})


def save_document(spark: SparkSession, folder: str, document: dict) -> str:
    """Store a document under the hash of its canonical form, in any folder that Spark reaches."""
    body = json.dumps(document, sort_keys=True, separators=(",", ":"))
    name = hashlib.sha256(body.encode()).hexdigest()
    write_text(spark, f"{folder.rstrip('/')}/{name}.json", body)
    return name


def load_document(spark: SparkSession, folder: str, name: str) -> dict:
    body = read_text(spark, f"{folder.rstrip('/')}/{name}.json")
    if body is None:
        raise FileNotFoundError(f"no document {name} in {folder}")
    if hashlib.sha256(body.encode()).hexdigest() != name:
        raise ValueError(f"document {name} was changed after it was saved")
    return json.loads(body)
