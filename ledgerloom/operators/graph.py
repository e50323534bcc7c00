"""Daily payment graph: edges, reciprocity, cycles, reach, degrees and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.lineage import use_shared_folder

DAY = "window_start"


def edges(ledger: DataFrame) -> DataFrame:
    """Distinct directed pairs of each day with their first and last time."""
    return ledger.filter("from_key <> to_key").groupBy(F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias(DAY), F.col("from_key").alias("src"), F.col("to_key").alias("dst")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _hop(e: DataFrame, a: str, b: str) -> DataFrame:
    return e.select(DAY, F.col("src").alias(a), F.col("dst").alias(b))


def reciprocal(e: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Counterparties of an account with payments both ways; targets are cut out before the join."""
    first = _hop(e, "v", "u")
    if targets is not None:
        first = first.join(targets.select(DAY, F.col("account_key").alias("v")), [DAY, "v"], "left_semi")
    return first.join(_hop(e, "u", "v"), [DAY, "u", "v"]).groupBy(DAY, F.col("v").alias("account_key")).agg(F.count(F.lit(1)).cast("double").alias("reciprocal_cp"))


def cycles3(e: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Paths v -> u -> w -> v.

    A cycle is found once, at its account of the fewest edges (then the smallest name): only edges to accounts of more edges
    are paired there, so a hub's edges are never paired with each other.  Each account of a cycle then counts it.
    """
    degree = e.select(DAY, F.explode(F.array("src", "dst")).alias("k")).groupBy(DAY, "k").agg(F.count(F.lit(1)).alias("d"))
    named = e.select(DAY, "src", "dst").join(degree.select(DAY, F.col("k").alias("src"), F.struct("d", "k").alias("a")), [DAY, "src"]).join(degree.select(DAY, F.col("k").alias("dst"), F.struct("d", "k").alias("b")), [DAY, "dst"])
    out = named.filter("a < b").select(DAY, F.col("src").alias("v"), F.col("dst").alias("u"))
    back = named.filter("b < a").select(DAY, F.col("dst").alias("v"), F.col("src").alias("w"))
    closed = out.join(back, [DAY, "v"]).filter("u <> w").join(_hop(e, "u", "w"), [DAY, "u", "w"])
    members = closed.select(DAY, F.explode(F.array("v", "u", "w")).alias("account_key"))
    if targets is not None:
        members = members.join(targets.select(DAY, "account_key"), [DAY, "account_key"], "left_semi")
    return members.groupBy(DAY, "account_key").agg(F.count(F.lit(1)).cast("double").alias("cycles3"))


def reach2(e: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Distinct accounts two hops away in either direction, without the account itself; targets are cut out before the second hop."""
    def two(first: DataFrame, second: DataFrame, name: str) -> DataFrame:
        if targets is not None:
            first = first.join(targets.select(DAY, F.col("account_key").alias("v")), [DAY, "v"], "left_semi")
        return first.join(second, [DAY, "u"]).filter("v <> w").select(DAY, "v", "w").distinct().groupBy(DAY, F.col("v").alias("account_key")).agg(F.count(F.lit(1)).cast("double").alias(name))

    out = two(_hop(e, "v", "u"), _hop(e, "u", "w"), "reach2_out")
    back = two(_hop(e, "u", "v"), _hop(e, "w", "u"), "reach2_in")
    return out.join(back, [DAY, "account_key"], "full").fillna(0.0)


def neighbour_degrees(e: DataFrame) -> DataFrame:
    """Mean out-degree of the senders and mean in-degree of the receivers of every account."""
    out = e.groupBy(DAY, "src").agg(F.count(F.lit(1)).alias("d"))
    into = e.groupBy(DAY, "dst").agg(F.count(F.lit(1)).alias("d"))
    senders = e.join(out, [DAY, "src"]).groupBy(DAY, F.col("dst").alias("account_key")).agg(F.avg("d").alias("senders_mean_outdeg"))
    receivers = e.join(into, [DAY, "dst"]).groupBy(DAY, F.col("src").alias("account_key")).agg(F.avg("d").alias("receivers_mean_indeg"))
    return senders.join(receivers, [DAY, "account_key"], "full")


def components(e: DataFrame, group: str = DAY) -> DataFrame:
    """``group, node, root``: weakly connected components by smallest label, with pointer jumping.

    Labels are checkpointed each round; the loop ends when no label changes.
    """
    use_shared_folder(e.sparkSession)
    both = e.select(group, F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(e.select(group, F.col("dst").alias("node"), F.col("src").alias("other"))).distinct().checkpoint()
    labels = both.groupBy(group, "node").agg(F.least(F.col("node"), F.min("other")).alias("root")).checkpoint()
    while True:
        near = both.join(labels.select(group, F.col("node").alias("other"), F.col("root").alias("seen")), [group, "other"]).groupBy(group, "node").agg(F.min("seen").alias("seen"))
        lower = labels.join(near, [group, "node"]).select(group, "node", F.least("root", "seen").alias("root"), F.col("root").alias("before"))
        jump = lower.select(group, F.col("node").alias("root"), F.col("root").alias("further"))
        new = lower.join(jump, [group, "root"], "left").select(group, "node", F.least("root", F.coalesce("further", "root")).alias("root"), "before").checkpoint()
        changed = new.filter("root <> before").limit(1).count()
        labels = new.drop("before")
        if not changed:
            return labels


def component_sizes(labels: DataFrame, group: str = DAY) -> DataFrame:
    sizes = labels.groupBy(group, "root").agg(F.count(F.lit(1)).alias("n"))
    return labels.join(sizes, [group, "root"]).select(group, F.col("node").alias("account_key"), F.log10("n").alias("wcc_log10_size"))


def graph_features(e: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    keys = [DAY, "account_key"]
    nodes = e.select(DAY, F.explode(F.array("src", "dst")).alias("account_key")).distinct()
    nodes = nodes.join(targets, keys, "left_semi") if targets is not None else nodes
    out = nodes
    for block in (reciprocal(e, targets), cycles3(e, targets), reach2(e, targets)):
        out = out.join(block, keys, "left").fillna(0.0)
    return out.join(neighbour_degrees(e), keys, "left").join(component_sizes(components(e)), keys, "left")
