"""Account attributes, synthetic profiles, planted behaviour and simulated dispositions."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.hashing import choose, keyed_uniform, normal_quantile
from ledgerloom.operators.ledger import strip_zeros
from ledgerloom.operators.ranks import average_percentiles

#: How the data spell crypto platforms, what stands for their country, and the country of banks without a number.
CRYPTO_NAMES, CRYPTO, DOMESTIC = ("Crytpo",), "Crypto", "United States"
#: Points of a risk tier, and the sector of public bodies.
RISK_POINTS = {"low": 0, "medium": 1, "high": 2}
GOVERNMENT = "government_public_body"


@dataclass(frozen=True)
class ProfileRules:
    """What synthetic profiles are drawn from; weights need not sum to 1.  Sectors and occupations: name -> (weight, risk tier).

    Fixed values: the defaults.
    """

    sectors: dict[str, tuple[float, str]]
    occupations: dict[str, tuple[float, str]]
    individual_types: tuple[str, ...]
    public_types: tuple[str, ...]
    bands: tuple[str, ...] = ("low", "medium", "high", "very_high")
    band_cuts: tuple[float, ...] = (0.5, 0.9, 0.99)
    band_noise: float = 0.25
    band_prior: dict[str, float] = field(default_factory=lambda: {"low": 0.5, "medium": 0.35, "high": 0.12, "very_high": 0.03})
    onboarding: tuple[str, str] = ("2005-01-01", "2022-08-31")
    foreign_tiers: dict[str, float] = field(default_factory=lambda: {"low": 0.6, "medium": 0.3, "high": 0.1})
    rating_noise: float = 0.1
    rating_cuts: tuple[int, int] = (2, 3)
    behaviours: dict[str, str] = field(default_factory=dict)  # behaviour -> statistic, in order of preference
    archetypes: dict[str, tuple[str, ...]] = field(default_factory=dict)  # behaviour -> sectors that explain it
    candidate_percentile: float = 0.95
    planting: float = 1.0
    planted_bands: dict[str, float] = field(default_factory=lambda: {"high": 0.6, "very_high": 0.4})
    planted_occupation: str | None = None


def numbered_place(name: str) -> Column:
    """X of a bank called ``X Bank #n``; null for any other name."""
    x = F.trim(F.regexp_extract(name, r"^(.*?)\s*Bank\s*#\d+\s*$", 1))
    return F.when(F.col(name).rlike(r"^(.*?)\s*Bank\s*#\d+\s*$"), x)


def account_attributes(keys: DataFrame, accounts: DataFrame, countries: list[str], crypto: tuple[str, ...] = CRYPTO_NAMES) -> DataFrame:
    """``account_key, entity_type, bank_name, bank_location, bank_country`` of ``bank|account`` keys, banks without leading zeros.

    The location is X of a bank called ``X Bank #n``, else the domestic country; the country of a crypto platform is
    ``Crypto``.  A key without an account, an account without a bank name, and an X that is neither a listed country nor a
    crypto name fail the job.
    """
    parts = keys.select("account_key", strip_zeros(F.split("account_key", r"\|", 2)[0]).alias("bank_id"), F.split("account_key", r"\|", 2)[1].alias("account_number"))
    joined = parts.join(accounts.withColumn("known", F.lit(True)), ["bank_id", "account_number"], "left").withColumn("x", numbered_place("bank_name"))

    def failed(what: str, value: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{what} "), F.col(value))).cast("string")

    kind = F.when(F.col("known"), F.col("entity_type")).otherwise(failed("no account for", "account_key"))
    unknown = F.col("x").isNotNull() & ~F.col("x").isin(*countries, *crypto)
    place = F.when(F.col("known") & F.col("bank_name").isNull(), failed("no bank name for", "account_key")).when(unknown, failed("unknown place of a bank:", "x")).otherwise(F.coalesce("x", F.lit(DOMESTIC)))
    return joined.select("account_key", kind.alias("entity_type"), "bank_name", place.alias("bank_location"), F.when(F.col("x").isin(*crypto), CRYPTO).otherwise(F.coalesce("x", F.lit(DOMESTIC))).alias("bank_country"))


def _drawn(purpose: str, seed: int, stream: str, key: str, table: dict[str, float]) -> Column:
    return choose(keyed_uniform(purpose, seed, stream)(F.col(key)), list(table), list(table.values()))


def base_profile(attributes: DataFrame, volume: DataFrame, rules: ProfileRules, seed: int = 0) -> DataFrame:
    """Sector or occupation by type, country risk, expected activity and onboarding year of every account.

    Activity is the band of the volume's average-rank percentile among the type's active accounts, moved by one band with a
    probability of ``band_noise``; accounts without a volume draw from the prior.  Domestic banks are low risk, crypto
    platforms high, and every other country draws its tier once.
    """
    def u(stream: str) -> Column:
        return keyed_uniform("kyc", seed, stream)(F.col("account_key"))

    rows = attributes.join(volume.select("account_key", "volume_usd"), "account_key", "left")
    rows = rows.join(average_percentiles(rows.select("account_key", "entity_type", "volume_usd"), ["volume_usd"], ["account_key"], "entity_type").select("account_key", "pct_volume_usd"), "account_key", "left")
    at = sum(((F.coalesce("pct_volume_usd", F.lit(0.0)) > c).cast("int") for c in rules.band_cuts), F.lit(0))
    moved = at + F.when(F.col("u_noise") < rules.band_noise, F.when(F.col("u_way") < 0.5, -1).otherwise(1)).otherwise(0)
    band = F.get(F.array(*[F.lit(b) for b in rules.bands]), F.greatest(F.lit(0), F.least(F.lit(len(rules.bands) - 1), moved)))
    first, days = F.lit(rules.onboarding[0]).cast("date"), (date.fromisoformat(rules.onboarding[1]) - date.fromisoformat(rules.onboarding[0])).days + 1
    sector = _drawn("kyc", seed, "sector", "account_key", {k: w for k, (w, _) in rules.sectors.items()})
    occupation = _drawn("kyc", seed, "occupation", "account_key", {k: w for k, (w, _) in rules.occupations.items()})
    drawn = rows.withColumns({"u_noise": u("band_noise"), "u_way": u("band_dir"), "u_day": u("onboard")})
    return drawn.select(
        "account_key", "entity_type", "bank_location", "bank_country",
        F.when(F.col("bank_country") == DOMESTIC, "low").when(F.col("bank_country") == CRYPTO, "high").otherwise(_drawn("country_risk", seed, "tier", "bank_country", rules.foreign_tiers)).alias("country_risk"),
        F.when(F.col("entity_type").isin(*rules.public_types), GOVERNMENT).when(F.col("entity_type").isin(*rules.individual_types), occupation).otherwise(sector).alias("sector_or_occupation"),
        F.when(F.col("pct_volume_usd").isNotNull(), band).otherwise(_drawn("kyc", seed, "band_prior", "account_key", rules.band_prior)).alias("expected_activity_band"),
        F.year(F.date_add(first, F.floor(F.col("u_day") * days).cast("int"))).alias("onboarding_year"),
    )


def dominant_behaviour(stats: DataFrame, behaviours: dict[str, str]) -> DataFrame:
    """The behaviour whose statistic has the highest percentile among the day's accounts (0 if it is 0); ties go to the first listed."""
    columns = list(dict.fromkeys(behaviours.values()))
    ranked = stats.select("account_key", "window_start", *columns).join(average_percentiles(stats, columns, ["account_key", "window_start"], "window_start"), ["account_key", "window_start"])
    ranks = [F.when(F.col(c) > 0, F.col(f"pct_{c}")).otherwise(0.0) for c in behaviours.values()]
    top = ranked.select("account_key", "window_start", F.array(*ranks).alias("p")).withColumn("dominant_percentile", F.array_max("p"))
    return top.select("account_key", "window_start", F.element_at(F.array(*[F.lit(b) for b in behaviours]), F.array_position("p", F.col("dominant_percentile")).cast("int")).alias("dominant_behaviour"), "dominant_percentile")


def plant(profile: DataFrame, day_stats: DataFrame, rules: ProfileRules, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The profiles with planted explanations, and the record of who was a candidate, who was planted and with what.

    Accounts of the day whose dominant behaviour is extreme get, by a draw, a sector whose business looks like it (individuals
    one occupation, public bodies none) and a high activity band.  Only that day's statistics are read, no label.
    """
    found = dominant_behaviour(day_stats, rules.behaviours).drop("window_start")
    u = {s: keyed_uniform("plant", seed, s)(F.col("account_key")) for s in ("plant", "archetype", "band")}
    drawn = found.withColumns({f"u_{k}": v for k, v in u.items()})
    sector = F.lit(None).cast("string")
    for behaviour, sectors in rules.archetypes.items():
        sector = F.when(F.col("dominant_behaviour") == behaviour, choose(F.col("u_archetype"), list(sectors), [1.0] * len(sectors))).otherwise(sector)
    candidate = F.col("dominant_percentile") >= rules.candidate_percentile
    band = choose(F.col("u_band"), list(rules.planted_bands), list(rules.planted_bands.values()))
    record = drawn.select("account_key", candidate.alias("candidate"), (candidate & (F.col("u_plant") < rules.planting)).alias("planted"), "dominant_behaviour", "dominant_percentile", sector.alias("planted_sector"), band.alias("planted_band"))
    joined = profile.join(record.select("account_key", "planted", "planted_sector", "planted_band"), "account_key", "left")
    is_planted = F.coalesce("planted", F.lit(False))
    individual, public = F.col("entity_type").isin(*rules.individual_types), F.col("entity_type").isin(*rules.public_types)
    own = F.col("sector_or_occupation")
    work = F.when(is_planted & individual, F.lit(rules.planted_occupation) if rules.planted_occupation else own).when(is_planted & ~individual & ~public, F.coalesce("planted_sector", own)).otherwise(own)
    changed = joined.withColumns({"sector_or_occupation": work, "expected_activity_band": F.when(is_planted, F.col("planted_band")).otherwise(F.col("expected_activity_band"))})
    return changed.select(*profile.columns), record


def risk_rating(profile: DataFrame, rules: ProfileRules, seed: int = 0) -> DataFrame:
    """Points of the sector's and the country's risk, one more for the highest activity band, moved by one with a probability."""
    risk = {k: r for table in (rules.sectors, rules.occupations) for k, (_, r) in table.items()} | {GOVERNMENT: "low"}

    def points(of: Column, table: dict, what: str) -> Column:
        return F.coalesce(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[of], F.raise_error(F.lit(f"unknown {what}")).cast("int"))

    noise = F.when(keyed_uniform("kyc", seed, "rating_noise")(F.col("account_key")) < rules.rating_noise, F.when(keyed_uniform("kyc", seed, "rating_dir")(F.col("account_key")) < 0.5, -1).otherwise(1)).otherwise(0)
    score = points(F.col("sector_or_occupation"), {k: RISK_POINTS[r] for k, r in risk.items()}, "sector") + points(F.col("country_risk"), RISK_POINTS, "country risk") + (F.col("expected_activity_band") == rules.bands[-1]).cast("int") + noise
    medium, high = rules.rating_cuts
    return profile.withColumn("risk_points", score).withColumn("customer_risk_rating", F.when(F.col("risk_points") >= high, "high").when(F.col("risk_points") >= medium, "medium").otherwise("low"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def anchored_probability(p0: float, beta: float, n: str) -> Column:
    """``p0`` at one rule, moved by ``beta`` on the logit scale for every further one."""
    import math

    return sigmoid(F.lit(math.log(p0 / (1 - p0))) + beta * (F.col(n) - 1))


def dispositions(labelled: DataFrame, seed: int = 0, median_hours: float = 48.0, spread: float = 0.8, limits: tuple[float, float] = (1.0, 720.0)) -> DataFrame:
    """A simulated decision on every alert and the minute it is closed at, a lognormal delay after its creation."""
    def u(stream: str) -> Column:
        return keyed_uniform("dispositions", seed, stream)(F.col("alert_id"))

    confirm = F.when(F.col("is_true_positive"), anchored_probability(0.7, 0.5, "n_rules_triggered")).otherwise(anchored_probability(0.03, 0.2, "n_rules_triggered"))
    hours = F.least(F.lit(limits[1]), F.greatest(F.lit(limits[0]), median_hours * F.exp(spread * normal_quantile(u("delay")))))
    decided = labelled.withColumns({"disposition": F.when(u("decision") < confirm, "confirmed_suspicious").otherwise("closed_legitimate"), "delay_minutes": F.floor(hours * 60).cast("int")})
    return decided.withColumn("closed_at", F.expr("timestampadd(MINUTE, delay_minutes, created_at)")).select("alert_id", "account_key", "disposition", "closed_at")


def visible_dispositions(rows: DataFrame, as_of: str) -> DataFrame:
    return rows.filter(F.col("closed_at") < F.lit(as_of).cast("timestamp_ntz"))


def flagged_counterparties(legs: DataFrame, dispositions: DataFrame, lookback_days: int = 1) -> DataFrame:
    """``account_key, as_of, n_counterparties, n_flagged`` at the end of every day on which an account has a leg in the lookback.

    Counterparties are those of the last ``lookback_days`` days; flagged are those with a disposition that was confirmed and
    closed before ``as_of``.
    """
    confirmed = dispositions.filter("disposition = 'confirmed_suspicious'").groupBy(F.col("account_key").alias("counterparty")).agg(F.min("closed_at").alias("closed"))
    day = F.expr("interval 1 day")
    ends = F.explode(F.sequence(F.col("window_start") + day, F.col("window_start") + F.expr(f"interval {int(lookback_days)} day"), day)).alias("as_of")
    met = legs.select("account_key", "counterparty", ends).distinct().join(confirmed, "counterparty", "left")
    return met.groupBy("account_key", "as_of").agg(F.count(F.lit(1)).alias("n_counterparties"), F.count(F.when(F.col("closed") < F.col("as_of"), 1)).alias("n_flagged"))


def planting_realisation(alerts: DataFrame, labels: DataFrame, planting: DataFrame) -> DataFrame:
    """One row for accounts with a true alert and one for the others: how many were planted, and how often a planted behaviour is one of the account's own rules.

    ``alerts``: alert_id, account_key, triggered_rules; ``labels``: alert_id, is_true_positive; ``planting``: account_key,
    planted, dominant_behaviour.  Rules are collected per account, at most one of each rule.
    """
    rules = alerts.join(labels.select("alert_id", "is_true_positive"), "alert_id").select("account_key", "is_true_positive", F.explode_outer("triggered_rules").alias("rule"))
    account = rules.groupBy("account_key").agg(F.bool_or("is_true_positive").alias("laundering_account"), F.collect_set("rule").alias("rules"))
    met = account.join(planting.select("account_key", "planted", "dominant_behaviour"), "account_key", "left").withColumn("planted", F.coalesce("planted", F.lit(False)))
    own = F.col("planted") & F.coalesce(F.array_contains("rules", F.col("dominant_behaviour")), F.lit(False))
    return met.groupBy("laundering_account").agg(F.count(F.lit(1)).alias("n_accounts"), F.round(F.avg(F.col("planted").cast("int")), 6).alias("planted_rate"), F.round(F.avg(own.cast("int")), 6).alias("explains_own_alert_rate"))


def alert_lift(accounts: DataFrame, fit_alerts: DataFrame, later_alerts: DataFrame, flags: list[str]) -> DataFrame:
    """``flag``, share of accounts that have it, and rates of later alerts and true alerts with and without it.

    Only accounts without an alert in ``fit_alerts`` count; ``later_alerts`` has account_key and is_true_positive.
    """
    later = later_alerts.groupBy("account_key").agg(F.bool_or("is_true_positive").alias("hit"))
    pool = accounts.join(fit_alerts.select("account_key").distinct(), "account_key", "left_anti").join(later, "account_key", "left")
    long = pool.select(F.col("hit").isNotNull().cast("int").alias("alerted"), F.coalesce("hit", F.lit(False)).cast("int").alias("true"), F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.coalesce(F.col(f), F.lit(False)).alias("has")) for f in flags])).alias("f")).select("alerted", "true", "f.*")

    def rate(column: str, has: bool):
        return F.avg(F.when(F.col("has") == has, F.col(column)))

    found = long.groupBy("flag").agg(F.count(F.lit(1)).alias("n_accounts"), F.avg(F.col("has").cast("int")).alias("share"), *[rate(c, h).alias(f"{c}_rate_{'with' if h else 'without'}") for c in ("alerted", "true") for h in (True, False)])
    lifts = [F.round(F.try_divide(F.col(f"{c}_rate_with"), F.col(f"{c}_rate_without")), 6).alias(f"{c}_lift") for c in ("alerted", "true")]
    return found.select("flag", "n_accounts", *[F.round(c, 6).alias(c) for c in found.columns[2:]], *lifts)
