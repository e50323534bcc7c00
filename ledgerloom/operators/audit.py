"""Data-quality analyses of the ledger; each is one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ranks import with_neighbour


def _n(condition: Column | str) -> Column:
    return F.count(F.when(F.expr(condition) if isinstance(condition, str) else condition, 1))


def daily_volume(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("is_laundering").cast("long").alias("n_laundering"))


def complete_days(daily: DataFrame, share: float = 0.5) -> DataFrame:
    """Days with at least ``share`` of the median day's rows."""
    middle = daily.agg(F.median("n").alias("m")).first()["m"]
    return daily.withColumn("complete", F.col("n") >= F.floor(F.lit(share * (middle or 0))))


def hourly_histogram(ledger: DataFrame, day: str) -> DataFrame:
    """24 bins of one day, empty ones included."""
    hours = ledger.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = ledger.filter(F.to_date("ts") == F.lit(day).cast("date")).groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.join(F.broadcast(counts), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def timestamp_ties(ledger: DataFrame) -> DataFrame:
    per = ledger.groupBy("ts").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_distinct"), F.max("n").alias("most"), F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 9).alias("share_shared"))


def schema_audit(ledger: DataFrame) -> DataFrame:
    """Nulls, empties, ranges and mismatches in one aggregation."""
    return ledger.agg(
        F.count(F.lit(1)).alias("n"), *[_n(F.col(c).isNull()).alias(f"null_{c}") for c in ("ts", "from_account", "to_account", "amount_paid", "amount_received", "attempt_id")], *[_n(F.col(c) == "").alias(f"empty_{c}") for c in ("from_bank", "to_bank", "payment_format")],
        F.min("amount_paid").alias("least_paid"), F.max("amount_paid").alias("most_paid"), F.round(F.median("amount_paid"), 6).alias("median_paid"), F.round(F.percentile("amount_paid", F.lit(0.99)), 6).alias("p99_paid"), _n("amount_paid = 0").alias("n_zero"), _n("amount_paid < 0").alias("n_negative"),
        _n("amount_paid = floor(amount_paid)").alias("n_integer"), _n("payment_currency <> receiving_currency").alias("n_cross_currency"), _n("payment_currency = receiving_currency AND amount_paid <> amount_received").alias("n_mismatch"), _n("from_key = to_key").alias("n_self"),
    )


def category_counts(ledger: DataFrame, column: str) -> DataFrame:
    return ledger.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value")


def label_rates(ledger: DataFrame) -> DataFrame:
    """Label rate and lift of eight categories in one pass with grouping sets."""
    derived = {"cross_currency": F.col("payment_currency") != F.col("receiving_currency"), "self_transfer": F.col("from_key") == F.col("to_key"), "integer_amount": F.col("amount_paid") == F.round("amount_paid"), "hour": F.hour("ts"), "minute": F.minute("ts")}
    plain = ["payment_format", "payment_currency", "receiving_currency"]
    names = [*plain, *derived]
    rows = ledger.select("is_laundering", *plain, *[v.cast("string").alias(k) for k, v in derived.items()])
    total = rows.agg(F.avg("is_laundering").alias("r")).first()["r"]
    sets = rows.groupingSets([[F.col(c)] for c in names], *[F.col(c) for c in names]).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.sum("is_laundering").cast("long").alias("n_pos"))
    which, value = F.lit(names[-1]), F.col(names[-1])
    for i, c in enumerate(names[:-1]):
        bits = (1 << len(names)) - 1 - (1 << (len(names) - 1 - i))
        which, value = F.when(F.col("gid") == bits, c).otherwise(which), F.when(F.col("gid") == bits, F.col(c)).otherwise(value)
    rate = F.col("n_pos") / F.col("n")
    return sets.select(which.alias("category"), value.alias("value"), "n", "n_pos", F.round(rate, 9).alias("rate"), F.round(F.try_divide(rate, F.lit(total)), 6).alias("lift"))


def duplicates(df: DataFrame, columns: list[str], label: str | None = None) -> DataFrame:
    """Groups of equal rows: groups, surplus rows and groups whose label differs."""
    both = [F.count_distinct(label).alias("labels")] if label else [F.lit(1).alias("labels")]
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), *both).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_surplus"), _n("labels > 1").alias("n_conflicts"))


def key_audit(ledger: DataFrame) -> DataFrame:
    """Distinct keys, accounts in several banks and banks whose spellings meet without their zeros."""
    from ledgerloom.operators.ledger import strip_zeros

    keys = ledger.select(F.explode(F.array(F.struct(F.col("from_bank").alias("bank"), F.col("from_account").alias("account")), F.struct(F.col("to_bank").alias("bank"), F.col("to_account").alias("account")))).alias("k")).select("k.*").distinct()
    banks = keys.select("bank", strip_zeros("bank").alias("plain")).distinct().groupBy("plain").agg(F.count(F.lit(1)).alias("spellings"))
    per = keys.groupBy("account").agg(F.count(F.lit(1)).alias("banks"), F.count_distinct(strip_zeros("bank")).alias("plain_banks"))
    one = per.agg(F.count(F.lit(1)).alias("n_accounts"), F.sum("banks").cast("long").alias("n_keys"), _n("banks > 1").alias("n_in_several_banks"), _n("plain_banks < banks").alias("n_padded"))
    return one.withColumn("n_banks_by_spelling", F.lit(banks.agg(F.max("spellings").alias("m")).first()["m"]).cast("long"))


def counts_by_period(ledger: DataFrame) -> DataFrame:
    from ledgerloom.operators.ledger import period_of

    return ledger.groupBy(period_of().alias("period")).agg(F.count(F.lit(1)).alias("n"), F.sum("is_laundering").cast("long").alias("n_laundering"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def attempts(ledger: DataFrame, typologies: DataFrame | None = None) -> DataFrame:
    """Structure of laundering attempts: payments, span and distinct accounts on both sides, and with ``typologies``
    (``attempt_id, typology``) what they are."""
    rows = ledger.filter("attempt_id IS NOT NULL")
    base = rows.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("n_txns"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.round((F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) / 3600.0), 6).alias("hours"))
    people = rows.select("attempt_id", F.explode(F.array("from_key", "to_key")).alias("a")).distinct().groupBy("attempt_id").agg(F.count(F.lit(1)).alias("n_accounts"))
    found = base.join(people, "attempt_id")
    return found if typologies is None else found.join(typologies, "attempt_id")


def typology_audit(attempts: DataFrame, span_end: str) -> DataFrame:
    """Sizes, accounts and durations of each typology's attempts, and how many go on past the calendar's end."""
    q = [F.percentile("hours", F.lit(0.9)).alias("p90_hours"), F.percentile("hours", F.lit(0.99)).alias("p99_hours")]
    return attempts.groupBy("typology").agg(
        F.count(F.lit(1)).alias("n_attempts"), F.sum("n_txns").alias("n_txns"), F.median("n_txns").alias("median_txns"), F.max("n_txns").alias("most_txns"), F.median("n_accounts").alias("median_accounts"),
        F.max("n_accounts").alias("most_accounts"), F.median("hours").alias("median_hours"), *q, F.max("hours").alias("most_hours"), _n(F.col("end_ts") >= F.lit(span_end).cast("timestamp_ntz")).alias("n_past_span"),
    )


def roles(ledger: DataFrame) -> DataFrame:
    """Accounts by their roles: both, only sender, only receiver."""
    per = ledger.filter("from_key <> to_key").select(F.explode(F.array(F.struct(F.col("from_key").alias("a"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_key").alias("a"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("r")).groupBy("r.a").agg(F.max("r.o").alias("o"), F.max("r.i").alias("i"))
    return per.groupBy(F.when(F.col("o") + F.col("i") == 2, "both").when(F.col("o") == 1, "out_only").otherwise("in_only").alias("role")).agg(F.count(F.lit(1)).alias("n"))


def account_labels(ledger: DataFrame) -> DataFrame:
    """``bank, account, y``: every account of the ledger and whether a laundering payment touches it."""
    ends = F.array(*[F.struct(F.col(f"{side}_bank").alias("bank"), F.col(f"{side}_account").alias("account")) for side in ("from", "to")])
    return ledger.select("is_laundering", F.explode(ends).alias("e")).groupBy("e.bank", "e.account").agg(F.max("is_laundering").alias("y"))


def identifier_leakage(accounts: DataFrame, attributes: DataFrame | None = None, support: int = 20, top: int = 5) -> DataFrame:
    """``what, value, n, n_pos, rate, lift`` of labelled accounts by parts of their identifiers.

    Last character, length, and where ``attributes`` (``bank, account`` and more columns, banks without leading zeros) are
    given, each of its columns, nulls last; of two-character prefixes and of banks the ``top`` lifts with enough ``support``.
    """
    from ledgerloom.operators.ledger import strip_zeros

    rows = accounts.withColumn("bank", strip_zeros("bank"))
    extra = [] if attributes is None else [c for c in attributes.columns if c not in ("bank", "account")]
    if attributes is not None:
        rows = rows.join(attributes, ["bank", "account"], "left")
    parts = {"last_character": F.substring("account", -1, 1), "length": F.char_length("account").cast("string"), "prefix": F.substring("account", 1, 2), "bank": F.col("bank")} | {c: F.col(c).cast("string") for c in extra}
    total = rows.agg(F.avg("y").alias("r")).first()["r"]
    long = rows.select("y", F.explode(F.array(*[F.struct(F.lit(k).alias("what"), v.alias("value")) for k, v in parts.items()])).alias("p")).select("y", "p.*")
    counts = long.groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("n_pos"))
    rated = counts.withColumns({"rate": F.round(F.col("n_pos") / F.col("n"), 9), "lift": F.round(F.try_divide(F.col("n_pos") / F.col("n"), F.lit(total)), 6)})
    listed = F.col("what").isin("prefix", "bank")
    best = [rated.filter((F.col("what") == w) & (F.col("n") >= support)).orderBy(F.col("lift").desc(), "value").limit(top) for w in ("prefix", "bank")]
    return rated.filter(~listed).unionByName(best[0]).unionByName(best[1]).orderBy("what", F.col("value").asc_nulls_last())


def position_deciles(ledger: DataFrame) -> DataFrame:
    """Label counts by file position; positions are data (``row_id``)."""
    last = ledger.agg(F.max("row_id").alias("m")).first()["m"] or 0
    return ledger.groupBy(F.floor(F.col("row_id") * 10 / F.lit(last + 1)).cast("int").alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.sum("is_laundering").cast("long").alias("n_pos"))


def contiguity(ledger: DataFrame) -> DataFrame:
    """Share of laundering rows whose next row by id launders too."""
    following = with_neighbour(ledger.select("row_id", "is_laundering"), "row_id", ["is_laundering"], 1).filter("is_laundering = 1")
    return following.agg(F.count("near_is_laundering").alias("n"), F.round(F.avg("near_is_laundering"), 9).alias("p_next"))


def order_inversions(ledger: DataFrame) -> DataFrame:
    """Rows whose time is before that of the row just above them in the file."""
    return with_neighbour(ledger.select("row_id", "ts"), "row_id", ["ts"], -1).agg(_n("ts < near_ts").alias("n_inversions"))


def pattern_coverage(ledger: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """How pattern rows and laundering payments cover each other."""
    rows = ledger.filter("is_laundering = 1")
    return rows.agg(F.count(F.lit(1)).alias("n_laundering")).withColumns({
        "n_unattributed": F.lit(rows.join(patterns, keys, "left_anti").count()), "n_pattern_rows": F.lit(patterns.count()), "n_patterns_missing": F.lit(patterns.join(ledger, keys, "left_anti").count()),
    })


def bank_forms(accounts: DataFrame) -> DataFrame:
    """Counts of the forms of bank names."""
    from ledgerloom.operators.profiles import CRYPTO_NAMES, numbered_place

    place = numbered_place("bank_name")
    form = F.when(place.isin(*CRYPTO_NAMES), "crypto").when(place.isNotNull(), "country").otherwise("domestic")
    return accounts.groupBy(form.alias("form")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.element_at(F.split("bank_name", " "), -1)).alias("n_last_words"))


def store_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: rows and two sums of row hashes, reduced so that no sum overflows."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(F.shiftrightunsigned(h, 32)), F.lit(0)).alias("s"))


def footprint(df: DataFrame) -> DataFrame:
    """Bytes of a table in memory, over all rows: strings as they are (with an 8-byte offset), and as 4-byte codes of a dictionary.

    Other columns count their width, 8 bytes unless they are narrower.  Values are first counted per column, so the
    dictionary's size comes from distinct values.
    """
    narrow = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    texts = [c for c, kind in df.dtypes if kind == "string"]
    width = sum(narrow.get(kind, 8) for _, kind in df.dtypes if kind != "string")
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    if not texts:
        return rows.select("n_rows", (F.col("n_rows") * width).alias("string_bytes"), (F.col("n_rows") * width).alias("dictionary_bytes"))
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c), F.lit("")).alias("v")) for c in texts])).alias("x")).groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("n"))
    size = F.octet_length("v").cast("long")
    sums = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.coalesce(F.sum(size * F.col("n")), F.lit(0)).alias("all_bytes"), F.coalesce(F.sum(size + 8), F.lit(0)).alias("distinct_bytes"))
    n = F.expr(f"cells div {len(texts)}")
    return sums.select(n.alias("n_rows"), (n * width + F.col("cells") * 8 + F.col("all_bytes")).alias("string_bytes"), (n * width + F.col("cells") * 4 + F.col("distinct_bytes")).alias("dictionary_bytes"))
