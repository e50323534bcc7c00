"""Labels, splits and their guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class HoldoutRefused(ValueError):
    """Labels of the holdout are asked for."""


def laundering_legs(legs: DataFrame) -> DataFrame:
    """Distinct (account, payment) rows of laundering payments."""
    return legs.filter("is_laundering = 1").select("account_key", "row_id", "window_start", "attempt_id", "ts").dropDuplicates(["account_key", "row_id"])


def positive_days(found: DataFrame) -> DataFrame:
    return found.groupBy("account_key", "window_start").agg(F.count_distinct("row_id").alias("n_laundering_txns"), F.array_sort(F.collect_set("attempt_id")).alias("attempt_ids"), F.bool_or(F.col("attempt_id").isNull()).alias("has_unattributed"))


def label_alerts(alerts: DataFrame, positive: DataFrame) -> DataFrame:
    """Every alert with its label; the number of alerts must not change."""
    joined = alerts.join(positive.withColumn("hit", F.lit(True)), ["account_key", "window_start"], "left")
    return joined.withColumns({"is_true_positive": F.coalesce("hit", F.lit(False)), "n_laundering_txns": F.coalesce("n_laundering_txns", F.lit(0).cast("long")), "attempt_ids": F.coalesce("attempt_ids", F.array().cast("array<int>")), "has_unattributed": F.coalesce("has_unattributed", F.lit(False))}).drop("hit")


def keep_count(before: DataFrame, after: DataFrame, what: str) -> DataFrame:
    """``after``, unless its row count differs from ``before``'s."""
    a, b = before.count(), after.count()
    if a != b:
        raise ValueError(f"{what} changed the number of rows from {a} to {b}")
    return after


def load_labels(read, periods: list[str], refused: str = "TEST") -> DataFrame:
    """Labels of some periods; the holdout is refused before ``read`` opens anything."""
    if refused in periods:
        raise HoldoutRefused(f"labels of {refused} stay closed")
    return read().filter(F.col("period").isin(*periods))


def unseen(rows: DataFrame, seen: DataFrame, period: str = "TEST") -> DataFrame:
    """Rows of a period whose account does not occur in ``seen``."""
    return rows.filter(F.col("period") == period).join(seen.select("account_key").distinct(), "account_key", "left_anti")


def strata(labelled: DataFrame) -> DataFrame:
    names = F.array_compact(F.array(F.when(F.size("attempt_ids") > 1, "several_attempts"), F.when(F.col("has_unattributed"), "unattributed"), F.when(F.col("n_laundering_txns") == 1, "single_payment"), F.when(F.size("attempt_ids") == 1, "one_attempt")))
    return labelled.filter("is_true_positive").withColumn("strata", names)


def entity_split(members: DataFrame, groups: list[tuple[str, float]], seed: int = 0) -> DataFrame:
    """``node, root, agent_group``: accounts that share an attempt or payment land in one group, drawn by a keyed hash."""
    from ledgerloom.functions.hashing import choose, keyed_uniform
    from ledgerloom.operators.graph import components

    pairs = members.select(F.lit(0).alias("g"), F.col("account_key").alias("src"), F.concat(F.lit("\u0001"), F.col("member").cast("string")).alias("dst"))
    labels = components(pairs, "g").filter(~F.col("node").startswith("\u0001"))
    smallest = labels.groupBy("root").agg(F.min("node").alias("first"))
    drawn = smallest.withColumn("agent_group", choose(keyed_uniform("agent_split", seed, "group")(F.col("first")), [g for g, _ in groups], [w for _, w in groups]))
    return labels.join(drawn, "root").select("node", "root", "agent_group")


def crossing(members: DataFrame, split: DataFrame) -> DataFrame:
    """Attempts or payments whose accounts are in more than one group; a valid split has none."""
    return members.join(split.withColumnRenamed("node", "account_key"), "account_key").groupBy("member").agg(F.count_distinct("agent_group").alias("n_groups")).filter("n_groups > 1")


def group_counts(members: DataFrame, split: DataFrame) -> DataFrame:
    """``agent_group, n_components, n_accounts, n_members, largest`` of a split: components, accounts, and their attempts and payments."""
    met = members.join(split.withColumnRenamed("node", "account_key"), "account_key")
    per = met.select("agent_group", "root", "account_key").distinct().groupBy("agent_group", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = per.groupBy("agent_group").agg(F.count(F.lit(1)).alias("n_components"), F.sum("n").alias("n_accounts"), F.max("n").alias("largest"))
    tied = met.select("agent_group", "member").distinct().groupBy("agent_group").agg(F.count(F.lit(1)).alias("n_members"))
    return sizes.join(tied, "agent_group").select("agent_group", "n_components", "n_accounts", "n_members", "largest")


def moved_alerts(before: DataFrame, after: DataFrame) -> DataFrame:
    """``from_group, to_group, n``: how many alerts that two splits share changed their group."""
    both = before.select("alert_id", F.col("agent_group").alias("from_group")).join(after.select("alert_id", F.col("agent_group").alias("to_group")), "alert_id")
    return both.filter("from_group <> to_group").groupBy("from_group", "to_group").agg(F.count(F.lit(1)).alias("n"))


def choose_variant(variants: list[str], gates: dict[str, dict[str, bool]]) -> str:
    """The first variant, in order, that passes all of its gates; none raises."""
    for name in variants:
        if gates[name] and all(gates[name].values()):
            return name
    raise ValueError(f"no variant of the split passes its gates: {gates}")


def share_bin(share: str, edges: list[float]) -> Column:
    """Name ``[low,high)`` of the bin of a share; the last bin holds its upper edge too, and a share outside is null."""
    found = F.lit(None).cast("string")
    for low, high in zip(edges[:-1], edges[1:]):
        upper = F.col(share) <= high if high == edges[-1] else F.col(share) < high
        found = F.when((F.col(share) >= low) & upper, f"[{low:g},{high:g})").otherwise(found)
    return found


def recurrence(rows: DataFrame, fold: str = "fold", account: str = "account_key") -> DataFrame:
    """``n_folds, n_accounts, n_positive``: accounts by the number of folds they occur in, and how many are ever positive."""
    per = rows.select(account, fold, "y").groupBy(account, fold).agg(F.max("y").alias("y")).groupBy(account).agg(F.count(F.lit(1)).alias("n_folds"), F.max("y").alias("y"))
    return per.groupBy("n_folds").agg(F.count(F.lit(1)).alias("n_accounts"), F.sum("y").cast("long").alias("n_positive"))


def involvement(legs: DataFrame) -> DataFrame:
    """``volume_usd, laundering_share, max_leg_launders`` of every account-day: how much of it is laundering, and whether its
    largest payment (any of them, if several are equal) is."""
    rows = legs.groupBy("account_key", "window_start").agg(F.sum("usd").alias("volume_usd"), F.sum(F.when(F.col("is_laundering") == 1, F.col("usd")).otherwise(0.0)).alias("dirty"), F.max("usd").alias("top"), F.max(F.when(F.col("is_laundering") == 1, F.col("usd"))).alias("top_dirty"))
    return rows.select("account_key", "window_start", "volume_usd", F.try_divide("dirty", "volume_usd").alias("laundering_share"), F.coalesce(F.col("top_dirty") == F.col("top"), F.lit(False)).alias("max_leg_launders"))
