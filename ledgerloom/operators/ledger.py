"""The ledger, its keys, periods, USD amounts and legs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Half-open periods of the 30-day calendar; one-day embargoes stand between them.
PERIODS = [
    ("BURN_IN", "2024-01-01", "2024-01-02"), ("TRAIN", "2024-01-02", "2024-01-14"), ("EMBARGO_1", "2024-01-14", "2024-01-15"), ("VALIDATION", "2024-01-15", "2024-01-19"),
    ("EMBARGO_2", "2024-01-19", "2024-01-20"), ("CALIBRATION", "2024-01-20", "2024-01-24"), ("EMBARGO_3", "2024-01-24", "2024-01-25"), ("TEST", "2024-01-25", "2024-01-31"),
]
#: USD per unit of the fixture's currencies.
RATES = {"US Dollar": 1.0, "Euro": 1.25, "Yen": 0.01}


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payments ledger, derived from the ``events`` table."""
    k = F.get_json_object("props", "$.k").cast("long")

    def of(who: Column, eight: Column, nine: Column, rest: Column) -> Column:
        return F.when(who % 10 == 8, eight).when(who % 10 == 9, nine).otherwise(rest)

    names, rates = [F.lit(x) for x in ("Euro", "Yen", "US Dollar")], [F.lit(x) for x in (1.25, 0.01, 1.0)]
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", k).withColumns({
        "paid": F.round(F.col("value") * 100, 2), "pc": of(F.col("user_id"), *names), "rc": of(F.col("k"), *names), "rp": of(F.col("user_id"), *rates), "rr": of(F.col("k"), *rates),
    })
    formats = {"click": "ACH", "view": "Cheque", "purchase": "Credit Card", "signup": "Wire"}
    kind = F.lit("Cash")
    for event, name in formats.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    return e.select(
        F.col("event_id").alias("row_id"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), F.lpad((F.col("user_id") % 7).cast("string"), 3, "0").alias("from_bank"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("from_account"), F.lpad((F.col("k") % 7).cast("string"), 3, "0").alias("to_bank"), F.concat(F.lit("U"), F.col("k").cast("string")).alias("to_account"),
        F.round(F.when(F.col("pc") == F.col("rc"), F.col("paid")).otherwise(F.col("paid") * F.col("rp") / F.col("rr")), 6).alias("amount_received"), F.col("rc").alias("receiving_currency"),
        F.col("paid").alias("amount_paid"), F.col("pc").alias("payment_currency"), kind.alias("payment_format"), (F.col("event_id") % 101 == 0).cast("int").alias("is_laundering"),
        F.when(F.col("event_id") % 202 == 0, F.floor(F.col("event_id") / 1010.0).cast("int")).alias("attempt_id"),
    ).withColumns({"from_key": account_key("from_bank", "from_account"), "to_key": account_key("to_bank", "to_account")})


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    name = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("First Bank of "), "n_name")).when(F.col("c_nationkey") == 1, F.concat(F.lit("Crytpo Bank #"), F.col("c_custkey").cast("string"))).otherwise(F.concat("n_name", F.lit(" Bank #"), F.col("c_nationkey").cast("string")))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select((F.col("c_custkey") % 7).cast("string").alias("bank_id"), F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("account_number"), name.alias("bank_name"), F.col("c_mktsegment").alias("entity_type"))


def countries(spark: SparkSession, sf_dir: str) -> list[str]:
    """The fixture's countries, one for each nation."""
    return sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name").collect())


def account_key(bank: str, account: str) -> Column:
    """``bank|account``; banks keep their leading zeros."""
    return F.concat_ws("|", bank, account)


def strip_zeros(bank: Column | str) -> Column:
    stripped = F.ltrim(F.col(bank) if isinstance(bank, str) else bank, F.lit("0"))
    return F.when(stripped == "", "0").otherwise(stripped)


def visible(df: DataFrame, as_of: datetime, since: datetime, ts: str = "ts") -> DataFrame:
    """Rows with ``since <= ts < as_of``: point-in-time, ties at ``as_of`` excluded."""
    if since >= as_of:
        raise ValueError("an empty window: since must be before as_of")
    if since.tzinfo or as_of.tzinfo:
        raise ValueError("the ledger's times are naive UTC")
    low, high = (F.lit(x).cast("timestamp_ntz") for x in (since.isoformat(sep=" "), as_of.isoformat(sep=" ")))
    return df.filter((F.col(ts) >= low) & (F.col(ts) < high))


def period_of(ts: str = "ts") -> Column:
    """Name of the period; null outside all of them."""
    found = F.lit(None).cast("string")
    for name, start, end in reversed(PERIODS):
        found = F.when((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")), name).otherwise(found)
    return found


def refuse_outside(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``period`` for every row; a row outside all periods fails the job."""
    return df.withColumn("period", F.coalesce(period_of(ts), F.raise_error(F.concat(F.lit("no period holds "), F.col(ts).cast("string")))))


def require_period(df: DataFrame, period: str) -> DataFrame:
    """The same rows; a row that is not of ``period`` (or of none) fails the job."""
    found = F.coalesce(F.col("period"), F.lit("no period"))
    return df.withColumn("period", F.when(found == period, F.col("period")).otherwise(F.raise_error(F.concat(F.lit("a row of "), found, F.lit(f" where only {period} may be"))).cast("string")))


def strict_lookup(column: str, table: dict, default=None) -> Column:
    """The value of a key; an unknown key fails the job unless there is a default."""
    found = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[F.col(column)]
    return F.coalesce(found, F.lit(default) if default is not None else F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column), F.lit("null")))))


def with_usd(df: DataFrame, rates: dict[str, float] = RATES) -> DataFrame:
    return df.withColumns({"usd_paid": F.col("amount_paid") * strict_lookup("payment_currency", rates), "usd_received": F.col("amount_received") * strict_lookup("receiving_currency", rates)})


def legs(df: DataFrame, channels: tuple[str, ...] = ("Cash", "Bitcoin")) -> DataFrame:
    """One row per role of every payment that is not to oneself; one scan, no union."""

    def leg(key: str, other: str, way: str, usd: str, amount: str, currency: str) -> Column:
        return F.struct(F.col(key).alias("account_key"), F.col(other).alias("counterparty"), F.lit(way).alias("direction"), F.col(usd).alias("usd"), F.col(amount).alias("amount"), F.col(currency).alias("currency"))

    both = F.array(leg("from_key", "to_key", "out", "usd_paid", "amount_paid", "payment_currency"), leg("to_key", "from_key", "in", "usd_received", "amount_received", "receiving_currency"))
    flags = df.filter("from_key <> to_key").select("row_id", "ts", "payment_format", "is_laundering", "attempt_id", "amount_paid", "payment_currency", (F.col("payment_currency") != F.col("receiving_currency")).alias("cross"), F.col("payment_format").isin(*channels).alias("high_risk"), F.explode(both).alias("leg"))
    return flags.select("row_id", "ts", F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("window_start"), "payment_format", "is_laundering", "attempt_id", "cross", "high_risk", "amount_paid", "payment_currency", "leg.*")


def usd_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legs(with_usd(ledger(spark, sf_dir)))
