"""Exchange rates from the ledger's own conversions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORTING = "US Dollar"


def pair_ratios(ledger: DataFrame) -> DataFrame:
    """Median log ratio of received to paid amounts of each ordered pair of currencies; one aggregation."""
    ratio = F.ln(F.col("amount_received") / F.col("amount_paid"))
    return ledger.filter("payment_currency <> receiving_currency AND amount_paid > 0 AND amount_received > 0").groupBy("payment_currency", "receiving_currency").agg(F.median(ratio).alias("median_log_ratio"), F.count(F.lit(1)).alias("n"))


def derive_rates(ledger: DataFrame, reporting: str = REPORTING, most_pairs: int = 10_000) -> dict[str, float]:
    """USD per unit of every currency: least squares over the pairs, weighted by their payments.

    Only the pairs (currencies squared) come to the driver; a currency without a chain of pairs to the reporting one raises.
    """
    rows = pair_ratios(ledger).limit(most_pairs + 1).collect()
    if len(rows) > most_pairs:
        raise ValueError("too many currency pairs")
    names = ledger.select(F.explode(F.array("payment_currency", "receiving_currency"))).distinct().limit(most_pairs + 1).collect()
    if len(names) > most_pairs:
        raise ValueError("too many currencies")
    seen = {r[0] for r in names}
    linked, grown = {reporting}, True
    while grown:
        more = {c for r in rows for c in (r["payment_currency"], r["receiving_currency"]) if {r["payment_currency"], r["receiving_currency"]} & linked} - linked
        linked |= more
        grown = bool(more)
    if reporting not in seen or seen - linked:
        raise ValueError(f"currencies without a path to {reporting}: {sorted(seen - linked) or [reporting]}")
    others = sorted(seen - {reporting})
    if not others:
        return {reporting: 1.0}
    at = {c: i for i, c in enumerate(others)}
    design, target = np.zeros((len(rows), len(others))), np.array([r["median_log_ratio"] for r in rows])
    for i, r in enumerate(rows):
        for currency, sign in ((r["payment_currency"], 1.0), (r["receiving_currency"], -1.0)):
            if currency != reporting:
                design[i, at[currency]] += sign
    weight = np.sqrt([float(r["n"]) for r in rows])
    solution = np.linalg.lstsq(design * weight[:, None], target * weight, rcond=None)[0]
    return {reporting: 1.0} | {c: float(f"{math.exp(solution[at[c]]):.10g}") for c in others}


def fx_audit(ledger: DataFrame) -> DataFrame:
    """Spread of each pair's ratio: median, quartiles, range and relative quartile distance."""
    ratio = F.col("amount_received") / F.col("amount_paid")
    q = ledger.filter("payment_currency <> receiving_currency AND amount_paid > 0").groupBy("payment_currency", "receiving_currency").agg(F.count(F.lit(1)).alias("n"), F.median(ratio).alias("median"), F.percentile(ratio, F.lit(0.25)).alias("q25"), F.percentile(ratio, F.lit(0.75)).alias("q75"), F.min(ratio).alias("least"), F.max(ratio).alias("most"))
    return q.withColumn("relative_iqr", F.try_divide(F.col("q75") - F.col("q25"), F.col("median")))


def daily_drift(ledger: DataFrame) -> DataFrame:
    """Each day's median ratio of a pair relative to its overall median."""
    ratio = F.col("amount_received") / F.col("amount_paid")
    rows = ledger.filter("payment_currency <> receiving_currency AND amount_paid > 0")
    daily = rows.groupBy("payment_currency", "receiving_currency", F.to_date("ts").alias("day")).agg(F.median(ratio).alias("day_median"))
    overall = rows.groupBy("payment_currency", "receiving_currency").agg(F.median(ratio).alias("overall"))
    return daily.join(overall, ["payment_currency", "receiving_currency"], "left").withColumn("drift", F.try_divide(F.col("day_median"), F.col("overall")) - 1)
