"""Account-day statistics of a stream: closed one-day windows behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_statistics(legs: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Windows include their start and exclude their end, as in the batch; a window is emitted once it is closed.

    ``legs`` streams the batch legs with ``ts`` as a timestamp.  Distinct counterparties are kept as sets, as streams
    have no distinct aggregates; the state is bounded by the counterparties of one day.
    """
    day = F.window("ts", "1 day")
    incoming = F.col("direction") == "in"
    found = legs.withWatermark("ts", late).groupBy(day, "account_key").agg(
        F.count(F.lit(1)).alias("n_txn"), F.sum("usd").alias("volume_usd"), F.max("usd").alias("max_txn_usd"),
        F.size(F.collect_set(F.when(incoming, F.col("counterparty")))).alias("n_distinct_senders"), F.size(F.collect_set(F.when(~incoming, F.col("counterparty")))).alias("n_distinct_receivers"),
    )
    return found.select("account_key", F.col("window.start").alias("window_start"), F.col("window.end").alias("as_of"), "n_txn", "volume_usd", "max_txn_usd", "n_distinct_senders", "n_distinct_receivers")
