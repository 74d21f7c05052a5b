"""Queries over transactions, limits, legs and raw lines, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.config import DEFAULTS
from tidemill.functions.exprs import holds, interval_label, merge_fraction, micros, null_if_zero, pdiv, percent_text, rounded_text
from tidemill.operators import budget, cleaning, evaluation, graph, history, scoring
from tidemill.operators.history import Carried
from tidemill.operators.redelivery import fixed_point, latest_rows
from tidemill.plans.training import LATEST_SQL
from tidemill.session import materialize, table
from tidemill.sources import audit, records

HOUR_US = 3_600_000_000
COLUMNS = ["service_code", "transaction_status", "transaction_date", "transaction_amount", "transaction_fees", "source_phone",
           "destination_phone", "partner_reference", "channel_type"]
WINDOWS = {"1h": HOUR_US, "24h": 24 * HOUR_US, "7d": 168 * HOUR_US}
RULES = DEFAULTS.rules()
MODEL_FEATURES = (
    "ratio", "above", "distance", "day_total", "day_ratio", "n_prior", "median_ratio", "max_ratio", "zscore", "days_since", "is_new",
    "n_1h", "n_24h", "n_7d", "sum_1h", "sum_24h", "sum_7d", "sent_before", "received_before", "received_to_sent", "minutes_since_received", "has_partner",
)


def held(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each transaction once, as it holds."""
    return latest_rows(table(spark, sf_dir, "transactions"), "transaction_code", "loaded_at", columns or COLUMNS)


def clean(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Of those, the ones with a usable date and a plausible amount."""
    rows = held(spark, sf_dir, *{*(columns or COLUMNS), "transaction_date", "transaction_amount"})
    dated, _ = cleaning.quarantine(rows, cleaning.usable_date("transaction_date"))
    return cleaning.quarantine(dated, cleaning.bounded("transaction_amount"))[0]


def clean_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The same, written once, where several branches of a plan read it; ``row_id`` tells rows apart that have no code."""
    return materialize(clean(spark, sf_dir, *columns).withColumn("row_id", F.monotonically_increasing_id()), "clean")


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.limits(table(spark, sf_dir, "service_thresholds"), "service_code", ["seuil_vigilance_unitaire_mru", "seuil_cumul_journalier_mru"])


def valid():
    """Whether a transaction went through."""
    return F.col("transaction_status") == "VALIDATED"


def typed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = table(spark, sf_dir, "ledger_legs").select("leg_id", "loaded_at", "posted_date__date_part", F.col("posted_date__fraction_ns").cast("string").alias("fraction"))
    return legs.withColumn("posted_at", merge_fraction("posted_date__date_part", "fraction")).select("leg_id", "loaded_at", "posted_at")


def validators_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "transactions")
    return cleaning.checks(raw, "transaction_code", "transaction_amount", 10_000_000, "service_code", table(spark, sf_dir, "service_thresholds"),
                           ["transaction_code", "service_code", "transaction_date", "source_phone"])


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = held(spark, sf_dir, "transaction_date", "transaction_amount")
    dated, undated = cleaning.quarantine(rows, cleaning.usable_date("transaction_date"))
    _, wild = cleaning.quarantine(dated, cleaning.bounded("transaction_amount"))
    return undated.select("transaction_code", F.lit("date").alias("reason")).unionByName(wild.select("transaction_code", F.lit("amount").alias("reason")))


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "transactions").select("transaction_code", "transaction_status", "transaction_fees", "loaded_at")
    return cleaning.drop_technical_duplicates(raw, "transaction_code", ["loaded_at", "transaction_status", "transaction_fees"])


def functional_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean(spark, sf_dir, "source_phone", "destination_phone", "transaction_amount", "transaction_date")
    return cleaning.flag_functional_duplicates(rows, ["source_phone", "destination_phone", "transaction_amount"], "transaction_date", "transaction_code", 10,
                                               "is_duplicate").select("transaction_code", "is_duplicate")


def clean_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.normalize_categoricals(clean(spark, sf_dir, "service_code", "transaction_status", "partner_reference"), ["service_code", "transaction_status"])
    return rows.select("transaction_code", "service_code", "transaction_status", valid().alias("is_valid"), cleaning.present("partner_reference").alias("has_partner"))


def phone_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.phone_activity(clean(spark, sf_dir, "source_phone", "destination_phone"), "source_phone", "destination_phone", "transaction_date", "transaction_amount")


def threshold_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean(spark, sf_dir, "service_code")
    return budget.ratio_to_limit(rows, dims(spark, sf_dir), "service_code", "transaction_amount", "seuil_vigilance_unitaire_mru").select(
        "transaction_code", "ratio", "above", "distance")


def daily_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean(spark, sf_dir, "source_phone", "service_code", "transaction_status")
    return budget.running_day_total(rows, ["source_phone", "service_code"], "transaction_date", "transaction_code", "transaction_amount", valid(), "day_total").select(
        "transaction_code", "day_total")


def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_table(spark, sf_dir, "source_phone")
    out = history.trailing(rows, ["source_phone"], "transaction_date", "transaction_code", fixed_point("transaction_amount", 2), WINDOWS, _stretch(rows))
    return out.select("transaction_code", *[f"n_{w}" for w in WINDOWS], *[(F.col(f"units_{w}") / 100.0).alias(f"sum_{w}") for w in WINDOWS])


def _stretch(rows: DataFrame) -> int:
    return history.stretch_of(rows, "transaction_date")


def _prior(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Strictly prior statistics of the sender's amounts, exact until the last step."""
    u = fixed_point("transaction_amount", 2)
    got = history.before(rows, ["source_phone"], "transaction_date", "transaction_code", {
        "n_prior": Carried(F.lit(1)), "__m": Carried(F.when(u.isNotNull(), 1).otherwise(0)), "__s": Carried(u.cast("decimal(20,0)")),
        "__q": Carried(u.cast("decimal(19,0)") * u.cast("decimal(19,0)")), "__x": Carried(u, "max"), "__l": Carried(micros("transaction_date"), "max")}, base=base, stretch_us=_stretch(base))
    m, s, q = F.col("__m"), F.col("__s"), F.col("__q")
    spread = (m * q - s * s).cast("double")
    mean = F.when(m > 0, s.cast("double") / m / 100.0)
    std = F.when(m > 1, F.sqrt(spread / (m * (m - 1))) / 100.0)
    return (got.withColumn("mean_prior", mean).withColumn("std_prior", std).withColumn("max_prior", F.col("__x") / 100.0)
            .withColumn("zscore", (F.col("transaction_amount") - F.col("mean_prior")) / null_if_zero(F.col("std_prior")))
            .withColumn("max_ratio", pdiv(F.col("transaction_amount"), F.col("max_prior")))
            .withColumn("days_since", (micros("transaction_date") - F.col("__l")) / 86_400_000_000.0).drop("__m", "__s", "__q", "__x", "__l"))


def behavioral_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_table(spark, sf_dir, "source_phone")
    return _prior(rows, rows).select(
        "transaction_code", "n_prior", "max_prior", "mean_prior", "std_prior", "zscore", "max_ratio", "days_since")


def prior_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean(spark, sf_dir, "source_phone").select("transaction_code", "source_phone", "transaction_date", "transaction_amount")
    out = history.prior_median(rows, ["source_phone"], "transaction_date", "transaction_code", "transaction_amount", "median_prior")
    return out.select("transaction_code", "median_prior", pdiv(F.col("transaction_amount"), F.col("median_prior")).alias("median_ratio"))


def clean_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaning in one frame: first delivery of each code, plain categories, validity, partner, functional duplicates."""
    raw = table(spark, sf_dir, "transactions").select("transaction_code", "loaded_at", *COLUMNS)
    dated, _ = cleaning.quarantine(raw, cleaning.usable_date("transaction_date", DEFAULTS.first_year))
    kept, _ = cleaning.quarantine(dated, cleaning.bounded("transaction_amount", DEFAULTS.most_amount))
    out = cleaning.clean_transactions(kept, "transaction_code", ["loaded_at", "transaction_status", "transaction_fees"], ["service_code", "transaction_status"], "transaction_status",
                                      "VALIDATED", "partner_reference", ["source_phone", "destination_phone", "transaction_amount"], "transaction_date", DEFAULTS.duplicate_minutes)
    return out.select("transaction_code", "service_code", "transaction_status", "is_valid", "has_partner", "is_duplicate")


def offending_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first codes whose amount is beyond the bound."""
    return cleaning.offending(table(spark, sf_dir, "transactions"), "transaction_code", F.col("transaction_amount") > DEFAULTS.most_amount)


def unknown_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.unknown(table(spark, sf_dir, "staged_rows").filter("service_code <> ''"), "service_code", table(spark, sf_dir, "service_thresholds"))


def new_beneficiary(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = F.coalesce(F.col("destination_phone"), F.lit("")) != ""
    return history.first_occurrence(clean(spark, sf_dir, "source_phone", "destination_phone"), ["source_phone", "destination_phone"], "transaction_date",
                                    "transaction_code", "is_new", there).select("transaction_code", "is_new")


def _network(rows: DataFrame, base: DataFrame) -> DataFrame:
    """What each sender had sent and received, from and to how many, strictly before.

    ``base`` is a table of the same rows by ``row_id``; ``rows`` may have more columns.
    """
    u = F.coalesce(fixed_point("transaction_amount", 2), F.lit(0))
    there = F.coalesce(F.col("destination_phone"), F.lit("")) != ""
    known = materialize(history.first_occurrence(
        base.select("row_id", "transaction_code", "source_phone", "destination_phone", "transaction_date", "transaction_amount"),
        ["source_phone", "destination_phone"], "transaction_date", "transaction_code", "is_new", there), "pairs")
    new = F.col("is_new").cast("int")
    stretch = _stretch(base)
    sent = history.before(known, ["source_phone"], "transaction_date", "transaction_code", {"sent_units": Carried(u), "n_targets": Carried(new)}, stretch_us=stretch)
    got = history.before(known.filter(there), ["destination_phone"], "transaction_date", "transaction_code",
                         {"received_units": Carried(u), "n_senders": Carried(new)}, including=True, stretch_us=stretch)
    got = got.select("destination_phone", F.col("transaction_date").alias("received_at"), F.col("transaction_code").alias("received_code"), "received_units", "n_senders")
    got = materialize(got, "received")
    out = history.asof_backward(
        sent.select("row_id", "transaction_code", "source_phone", "transaction_date", "is_new", "sent_units", "n_targets"), got,
        ("source_phone", "destination_phone"), ("transaction_date", "received_at"), ("transaction_code", "received_code"),
        ["received_at", "received_units", "n_senders"], left_base=known, stretch_us=stretch)
    out = (out.withColumn("sent_before", F.col("sent_units") / 100.0).withColumn("received_before", F.coalesce(F.col("received_units"), F.lit(0)) / 100.0)
           .withColumn("n_senders", F.coalesce(F.col("n_senders"), F.lit(0)))
           .withColumn("received_to_sent", F.col("received_before") / null_if_zero(F.col("sent_before")))
           .withColumn("minutes_since_received", (micros("transaction_date") - micros("received_at")) / 60_000_000.0)
           .select("row_id", "is_new", *NETWORK))
    return rows.join(out, "row_id")


NETWORK = ["sent_before", "received_before", "n_targets", "n_senders", "received_to_sent", "minutes_since_received"]


def network_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_table(spark, sf_dir, "source_phone", "destination_phone")
    out = _network(rows.select("row_id", "transaction_code"), rows)
    return out.select("transaction_code", *NETWORK)


def features(spark: SparkSession, sf_dir: str, medians: bool = False) -> DataFrame:
    """All features of each transaction: one table of clean rows, to which each step adds columns. ``medians``: those that need them too."""
    base = clean_table(spark, sf_dir)
    d, stretch = dims(spark, sf_dir), _stretch(base)
    x = history.trailing(base, ["source_phone"], "transaction_date", "transaction_code", fixed_point("transaction_amount", 2), WINDOWS, stretch)
    x = budget.ratio_to_limit(x, d, "service_code", "transaction_amount", "seuil_vigilance_unitaire_mru")
    x = budget.running_day_total(x, ["source_phone", "service_code"], "transaction_date", "transaction_code", "transaction_amount", valid(), "day_total", stretch_us=stretch)
    x = x.join(d.select("__code", F.col("seuil_cumul_journalier_mru").alias("__limit")), F.col("service_code") == F.col("__code"), "left").withColumn(
        "day_ratio", pdiv(F.col("day_total"), F.col("__limit"))).drop("__code", "__limit")
    out = _network(_prior(x, base), base).withColumns({f"sum_{w}": F.col(f"units_{w}") / 100.0 for w in WINDOWS})
    if not medians:
        return out
    slim = base.select("row_id", "source_phone", "transaction_date", "transaction_code", "transaction_amount")
    median = history.prior_median(slim, ["source_phone"], "transaction_date", "transaction_code", "transaction_amount", "median_prior").select("row_id", "median_prior")
    return out.join(median, "row_id").withColumn("median_ratio", pdiv(F.col("transaction_amount"), F.col("median_prior")))


def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).select("transaction_code", *RULES, "n_rules", "is_suspect")


def _flagged(spark: SparkSession, sf_dir: str, medians: bool = False) -> DataFrame:
    return scoring.flag_rules(features(spark, sf_dir, medians), RULES, "n_rules", DEFAULTS.least_rules, "is_suspect")


def flagged_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many transactions at least three rules hold for, and their amount: the flags joined back by code."""
    flags = rule_flags(spark, sf_dir).filter("n_rules >= 3").select("transaction_code")
    rows = clean(spark, sf_dir, "transaction_amount").join(flags, "transaction_code")
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum(fixed_point("transaction_amount", 2)), F.lit(0)) / 100.0).alias("amount"))


def suspicion_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_flags(spark, sf_dir).groupBy("n_rules").agg(F.count(F.lit(1)).alias("n"))


def _consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean(spark, sf_dir, "source_phone", "service_code", "transaction_status").filter(valid())
    return budget.consumption(rows, dims(spark, sf_dir), "source_phone", "service_code", "transaction_date", "transaction_amount", "seuil_cumul_journalier_mru", 5)


def budget_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consumption(spark, sf_dir)


def budget_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.alerts(_consumption(spark, sf_dir)).select("entity", "code", "day", "day_rank", "month_rank", "worst_level")


def worst_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the severest alerts, the latest first."""
    out = budget.alerts(_consumption(spark, sf_dir)).filter("worst_rank > 0")
    return out.orderBy(F.desc("worst_rank"), F.desc("day"), "entity", "code").limit(50).select("entity", "code", "day", "worst_level")


def report_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 phones that sent most, and those of the severest alerts that are not among them."""
    most = graph.top(_metrics(spark, sf_dir).filter("phone is not null").select("phone", "sent"), "sent", "phone", 100).select("phone")
    alerted = worst_alerts(spark, sf_dir).filter("entity is not null").select(F.col("entity").alias("phone")).distinct()
    return most.withColumn("why", F.lit("amount")).unionByName(alerted.join(most, "phone", "left_anti").withColumn("why", F.lit("alert")))


def alert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.alert_history(budget.alerts(_consumption(spark, sf_dir)))


def budget_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.latest_per_key(_consumption(spark, sf_dir).select("entity", "code", "day", "day_total", "month_total"), ["entity", "code"], "day")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean(spark, sf_dir, "source_phone", "destination_phone", "transaction_status")
    return graph.edges(rows, "source_phone", "destination_phone", "transaction_code", "transaction_date", "transaction_amount", valid())


def edgelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def graph_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sizes(_edges(spark, sf_dir))


def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(_edges(spark, sf_dir), "dst", "src", "fan_in")


def fan_out_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top(graph.degree(_edges(spark, sf_dir), "src", "dst", "fan_out"), "fan_out", "node", 200)


def _passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_table(spark, sf_dir, "source_phone", "destination_phone")
    return graph.pass_through(_network(rows.select("row_id", "source_phone"), rows), "source_phone", "received_to_sent", "minutes_since_received")


def pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passing(spark, sf_dir).select("node", "n_rows", "n_quick", "quick_rate", F.round("median_delay", 6).alias("median_delay"), F.round("score", 6).alias("score"))


def closed_circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closed_circuits(_edges(spark, sf_dir)).select("code_out", "code_back", "a", "b")


def graph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = materialize(_edges(spark, sf_dir), "edges")
    out = graph.node_features(e, _passing(spark, sf_dir), graph.closed_circuits(e))
    return out.withColumn("score", F.round("score", 6))


def ego_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = materialize(_edges(spark, sf_dir), "edges")
    return graph.ego_sample(e, _passing(spark, sf_dir).filter("node is not null"), graph.closed_circuits(e))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per phone, senders and receivers alike: totals, distinct counterparties, services and days."""
    rows = clean_table(spark, sf_dir, "source_phone", "destination_phone", "service_code", "transaction_fees")
    u = lambda c: F.coalesce(F.sum(fixed_point(c, 2)), F.lit(0)) / 100.0
    # Counted by service and day first, so that no row is expanded for the distinct counts; sums of sums are exact.
    cell = rows.groupBy(F.col("source_phone").alias("phone"), "service_code", F.to_date("transaction_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(fixed_point("transaction_amount", 2)).alias("a"), F.sum(fixed_point("transaction_fees", 2)).alias("f"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)) / 100.0
    sent = cell.groupBy("phone").agg(F.sum("n").alias("n_sent"), total("a").alias("sent"), total("f").alias("fees"),
                                     F.size(F.collect_set("service_code")).cast("bigint").alias("n_services"), F.size(F.collect_set("day")).cast("bigint").alias("n_days"))
    got = rows.filter(F.coalesce("destination_phone", F.lit("")) != "").groupBy(F.col("destination_phone").alias("phone")).agg(u("transaction_amount").alias("received"))
    targets = graph.degree(rows.filter(F.coalesce("destination_phone", F.lit("")) != "").select("source_phone", "destination_phone"), "source_phone", "destination_phone", "n_targets")
    both = sent.join(got, "phone", "full").join(targets.withColumnRenamed("node", "phone"), "phone", "left")
    filled = both.fillna(0, ["n_sent", "sent", "fees", "n_services", "n_days", "received", "n_targets"])
    return materialize(filled.withColumn("is_sender", F.col("n_sent") > 0), "metrics")


def customer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir)


def customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phone of the phone map with all its metrics: sent, received, habits, closeness to limits, rules, alerts; 0 where there is nothing."""
    phones = table(spark, sf_dir, "customer_phone_map").select("phone", "tenure_days")
    flagged = _flagged(spark, sf_dir).groupBy(F.col("source_phone").alias("phone")).agg(
        F.avg(F.abs("zscore")).alias("mean_abs_z"), F.avg(holds(F.col("ratio").between(*DEFAULTS.near_limit)).cast("int")).alias("near_share"),
        F.avg(cleaning.present("partner_reference").cast("int")).alias("partner_share"), *[F.avg(F.col(r).cast("int")).alias(f"{r}_share") for r in RULES if r != "r5"])
    there = clean(spark, sf_dir, "source_phone", "destination_phone").filter(F.coalesce("destination_phone", F.lit("")) != "")
    senders = graph.degree(there, "destination_phone", "source_phone", "n_senders", nulls=False).withColumnRenamed("node", "phone")
    alerts = alert_history(spark, sf_dir).select(F.col("entity").alias("phone"), "n_alerts", "n_recent", "worst_rank")
    x = phones
    for part in (_metrics(spark, sf_dir).drop("is_sender"), senders, flagged, alerts):
        x = x.join(part, "phone", "left")
    rates = ["mean_abs_z", "near_share", "partner_share", *[f"{r}_share" for r in RULES if r != "r5"]]
    x = x.fillna(0, [c for c in x.columns if c not in ("phone", "tenure_days")])
    return (x.withColumn("circulated", F.round(F.col("sent") + F.col("received"), 2)).withColumn("is_sender", F.col("n_sent") > 0)
            .withColumn("active_share", F.col("n_days") / F.greatest("tenure_days", F.lit(1))).withColumns({c: F.round(c, 9) for c in rates}))


def norm_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).select("phone", "sent", "received", "is_sender")
    m = scoring.percent_rank_min(m, "received", "rank_all")
    m = scoring.percent_rank_min(m, "sent", "rank_senders", F.col("is_sender"))
    return m.select("phone", "rank_all", "rank_senders")


def norm_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scoring.scale_min_max(_metrics(spark, sf_dir), {"scaled_sent": "sent", "scaled_targets": "n_targets"}, F.col("is_sender"))
    m = scoring.scale_min_max(m, {"scaled_received": "received"}, reverse=True)
    return m.select("phone", *[F.round(c, 6).alias(c) for c in ("scaled_sent", "scaled_targets", "scaled_received")])


def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score from 0 to 1000 out of ranks and scales, its band, and the components in words."""
    m = scoring.scale_min_max(_metrics(spark, sf_dir), {"scaled_fees": "fees", "scaled_targets": "n_targets"}, F.col("is_sender"))
    m = scoring.percent_rank_min(m, "sent", "rank_sent", F.col("is_sender"))
    m = scoring.weighted_score(m, {"rank_sent": 500.0, "scaled_fees": 300.0, "scaled_targets": 200.0}, "score")
    m = m.withColumn("band", interval_label(F.col("score"), {"low": (0, 299), "middle": (300, 599), "high": (600, 1000)}, "none"))
    return scoring.ordered_phrases(m, [("rank_sent", F.lit("volume")), ("scaled_fees", F.lit("fees")), ("scaled_targets", F.lit("reach"))], "because").select(
        "phone", "score", "band", "because")


SCALED = ("r4_share", "r6_share", "near_share", "r3_share", "r1_share", "r2_share", "partner_share", "n_targets", "r7_share", "n_alerts", "n_recent", "worst_rank")


def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of five components, each out of ranks and scales of a customer's metrics; what a sender does is scaled among senders."""
    m = materialize(customer_profile(spark, sf_dir).select("phone", "tenure_days", "is_sender", "mean_abs_z", "n_senders", *SCALED), "profiles")
    m = scoring.percent_rank_min(m, "mean_abs_z", "rank_z", F.col("is_sender"))
    m = scoring.percent_rank_min(m, "tenure_days", "rank_new", reverse=True)
    m = scoring.scale_min_max(m, {f"x_{c}": c for c in SCALED}, F.col("is_sender"))
    m = scoring.scale_min_max(m, {"y_n_senders": "n_senders"})
    parts = DEFAULTS.composites()
    m = scoring.composite(m, parts)
    m = scoring.weighted_score(m, {n: getattr(DEFAULTS, f"{n}_weight") for n in parts}, "score")
    return m.select("phone", *[F.round(n, 6).alias(n) for n in parts], "score")


def score_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sender what it sent and received, in words and numbers, the larger share of the ranks first."""
    m = _metrics(spark, sf_dir).filter("is_sender").select("phone", "sent", "received")
    m = scoring.percent_rank_min(scoring.percent_rank_min(m, "sent", "rank_sent"), "received", "rank_received")
    say = lambda what, rank, amount: F.concat(F.lit(f"{what} "), rounded_text(F.col(amount)), F.lit(" (above "), percent_text(F.col(rank)), F.lit(")"))
    return scoring.ordered_phrases(m, [("rank_sent", say("sent", "rank_sent", "sent")), ("rank_received", say("received", "rank_received", "received"))], "because").select("phone", "because")


def service_hour_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean(spark, sf_dir, "service_code", "transaction_status")
    return rows.groupBy("service_code", F.hour("transaction_date").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~valid(), 1)).alias("n_failed")).withColumn("failed_share", F.round(F.col("n_failed") / F.col("n"), 4))


def monthly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean(spark, sf_dir, "transaction_status")
    return rows.groupBy(F.date_format("transaction_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(fixed_point("transaction_amount", 2)) / 100.0).alias("total"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir, "transaction_status").groupBy("transaction_status").agg(F.count(F.lit(1)).alias("n"))


def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean(spark, sf_dir, "transaction_status", "source_phone")
    u = fixed_point("transaction_amount", 2)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(valid(), 1)).alias("n_valid"), F.count_distinct("source_phone").alias("n_senders"),
                    (F.sum(u) / 100.0).alias("total"), (F.sum(F.when(valid(), u)) / 100.0).alias("total_valid"))


def largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return graph.top(clean(spark, sf_dir).select("transaction_code", "transaction_amount"), "transaction_amount", "transaction_code", 50)


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of the latest rows."""
    return graph.top(clean(spark, sf_dir).select("transaction_code", "transaction_date"), "transaction_date", "transaction_code", 50)


def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.walk_forward(clean(spark, sf_dir), "transaction_date", embargo_days=DEFAULTS.embargo_days)
    return out.groupBy("is_holdout", *[f"{k}_{i}" for i in (1, 2, 3) for k in ("train", "valid")]).agg(F.count(F.lit(1)).alias("n"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean(spark, sf_dir, "service_code", "transaction_status")
    x = budget.ratio_to_limit(rows, dims(spark, sf_dir), "service_code", "transaction_amount", "seuil_vigilance_unitaire_mru")
    return x.select("transaction_code", (~valid()).alias("label"), evaluation.clipped_share("ratio").alias("score"))


def baseline_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.average_precision(_judged(spark, sf_dir), "label", "score").select(F.round("average_precision", 9).alias("average_precision"))


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.precision_recall(_judged(spark, sf_dir), "label", "score")


def baseline_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline's average precision on every fold, with mean and deviation over the folds."""
    rows = clean(spark, sf_dir, "service_code", "transaction_status")
    x = budget.ratio_to_limit(rows, dims(spark, sf_dir), "service_code", "transaction_amount", "seuil_vigilance_unitaire_mru")
    x = x.select("transaction_date", (~valid()).alias("label"), evaluation.clipped_share("ratio").alias("score"))
    split = materialize(evaluation.walk_forward(x, "transaction_date", embargo_days=DEFAULTS.embargo_days), "folds")
    folds = [evaluation.average_precision(split.filter(f"valid_{i}"), "label", "score").select(F.lit(i).alias("fold"), F.round("average_precision", 9).alias("average_precision"))
             for i in range(1, DEFAULTS.folds + 1)]
    every = evaluation.with_spread(folds[0].unionByName(folds[1]).unionByName(folds[2]), [])
    return every.select("fold", "average_precision", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def leakage_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = evaluation.walk_forward(clean(spark, sf_dir), "transaction_date", embargo_days=DEFAULTS.embargo_days)
    return evaluation.leakage_folds(materialize(split.select("transaction_code", "transaction_date", *[f"{k}_{i}" for i in range(1, DEFAULTS.folds + 1) for k in ("train", "valid")]), "folds"),
                                    "transaction_date", "transaction_code", DEFAULTS.folds, DEFAULTS.embargo_days)


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's features of each transaction, its label, and which fold trains on it or is judged by it; written once."""
    x = _flagged(spark, sf_dir, medians=True).withColumn("has_partner", cleaning.present("partner_reference"))
    split = evaluation.walk_forward(x, "transaction_date", DEFAULTS.folds, DEFAULTS.embargo_days, DEFAULTS.holdout_share)
    keep = ["row_id", "transaction_code", "transaction_date", *MODEL_FEATURES, "is_suspect", "is_holdout", *[f"{k}_{i}" for i in range(1, DEFAULTS.folds + 1) for k in ("train", "valid")]]
    return evaluation.model_matrix(materialize(split.select(*keep), "matrix"), MODEL_FEATURES, "is_suspect")


def lr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir)
    return evaluation.scores(evaluation.fit_logistic(m.filter("not is_holdout")), m.filter("is_holdout"), ["row_id", "transaction_code", "label"])


def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final fit: all before the holdout, of which the newest tenth says when to stop; each row of the holdout with its score."""
    m = _matrix(spark, sf_dir)
    before, judged = m.filter("not is_holdout"), m.filter("is_holdout")
    train, newest = evaluation.newest_apart(before, "transaction_date", 0.1)
    return evaluation.scores(evaluation.fit_boosted(train, newest, seed=DEFAULTS.seed), judged, ["row_id", "transaction_code", "label"])


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of three models on every fold, with mean and deviation of each model over the folds."""
    return evaluation.cross_validate(_matrix(spark, sf_dir), DEFAULTS.folds, evaluation.clipped_share("ratio"), DEFAULTS.seed)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records below the header; one without a line number is none."""
    return table(spark, sf_dir, "raw_lines").filter(F.coalesce(F.col("line_no") != 1, F.lit(True)))


def field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.field_counts(_lines(spark, sf_dir), "line")


def position_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.position_profile(audit.position_counts(_lines(spark, sf_dir), "line"))


def binary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.binary_candidates(audit.position_counts(_lines(spark, sf_dir), "line"))


def low_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.low_cardinality(audit.position_counts(_lines(spark, sf_dir), "line")).select("position", F.array_join("values", "|").alias("vals"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.samples(_lines(spark, sf_dir), "line", "line_id").select("position", F.array_join("values", "|").alias("vals"))


def full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.full_audit(_lines(spark, sf_dir), "line", "line_id")
    return out.select("position", "n_seen", "n_nonempty", "pct_nonempty", "n_distinct", "many_distinct", "binary",
                      F.array_join("sample_values", "|").alias("sample_values"), F.array_join("distinct_values", "|").alias("distinct_values"))


def tolerant_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a typed row, whatever is wrong with it: short lines padded, long ones cut, what does not fit NULL."""
    names = records.NAMES
    raw = audit.padded(_lines(spark, sf_dir).select("line_id", "line"), "line", names)
    dates = {n.removesuffix("__date_part"): (n, f"{n.removesuffix('__date_part')}__fraction_ns") for n in names if n.endswith("__date_part")}
    typed = cleaning.cast_types(raw, dates, ["transaction_amount", "transaction_fees"], ["transaction_code"])
    return typed.select("line_id", "transaction_code", "service_code", "transaction_status", *dates, "transaction_date__fraction_ns", "transaction_amount", "transaction_fees",
                        "source_phone", "destination_phone", "partner_reference", "unclear_position_25")


CLEAN = f"""{LATEST_SQL}, clean AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, epoch_us(transaction_date) AS us, CAST(round(transaction_amount * 100) AS HUGEINT) AS u FROM held
  WHERE year(transaction_date) >= 2020 AND transaction_amount <= 10000000),
lim AS (SELECT upper(trim(service_code)) AS code, seuil_vigilance_unitaire_mru AS unit, seuil_cumul_journalier_mru AS daily FROM service_thresholds)"""
_PDIV = "CASE WHEN {1} = 0 THEN CASE WHEN {0} > 0 THEN 'inf'::DOUBLE WHEN {0} < 0 THEN '-inf'::DOUBLE END ELSE {0} / {1} END"
_RATIO = f"""rat AS (SELECT c.*, {_PDIV.format('transaction_amount', 'unit')} AS ratio, unit - transaction_amount AS distance, l.daily
  FROM clean c LEFT JOIN lim l ON c.service_code = l.code)"""
_RUN = "sum(CASE WHEN transaction_status = 'VALIDATED' THEN u ELSE 0 END) OVER (PARTITION BY source_phone, service_code, CAST(transaction_date AS DATE) ORDER BY us, transaction_code ROWS UNBOUNDED PRECEDING)::DOUBLE / 100.0::DOUBLE"


def _trail(f: str, us: int) -> str:
    part = "PARTITION BY source_phone"
    return (f"coalesce({f} OVER ({part} ORDER BY us RANGE BETWEEN {us - 1} PRECEDING AND CURRENT ROW), 0)"
            f" - coalesce({f} OVER ({part}, us ORDER BY transaction_code ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)")


_P = "OVER (PARTITION BY source_phone ORDER BY us, transaction_code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_PRIOR = f"""pr0 AS (SELECT *, count(*) {_P} AS n_prior, count(u) {_P} AS m, sum(u) {_P} AS s, sum(u * u) {_P} AS q,
    max(u) {_P}::DOUBLE / 100.0::DOUBLE AS max_prior, max(us) {_P} AS lastus FROM clean),
pr1 AS (SELECT *, CASE WHEN m > 0 THEN s::DOUBLE / m::DOUBLE / 100.0::DOUBLE END AS mean_prior,
    CASE WHEN m > 1 THEN sqrt((m * q - s * s)::DOUBLE / (m * (m - 1))::DOUBLE) / 100.0::DOUBLE END AS std_prior FROM pr0),
prior AS (SELECT *, (transaction_amount - mean_prior) / CASE WHEN std_prior <> 0 THEN std_prior END AS zscore,
    {_PDIV.format('transaction_amount', 'max_prior')} AS max_ratio, (us - lastus) / 86400000000.0::DOUBLE AS days_since FROM pr1)"""
_FIRST = "(coalesce(destination_phone, '') <> '' AND row_number() OVER (PARTITION BY source_phone, destination_phone ORDER BY us, transaction_code) = 1)"
_NET = f"""fo AS (SELECT *, {_FIRST} AS is_new FROM clean),
rc0 AS (SELECT destination_phone AS phone, us AS rus, sum(u) AS ru, sum(is_new::INT) AS rs FROM fo WHERE coalesce(destination_phone, '') <> '' GROUP BY ALL),
rc AS (SELECT phone, rus, sum(ru) OVER w AS ru, sum(rs) OVER w AS rs FROM rc0 WINDOW w AS (PARTITION BY phone ORDER BY rus ROWS UNBOUNDED PRECEDING)),
sn AS (SELECT *, coalesce(sum(u) {_P}, 0) AS su, coalesce(sum(is_new::INT) {_P}, 0) AS n_targets FROM fo),
net AS (SELECT sn.*, su::DOUBLE / 100.0::DOUBLE AS sent_before, coalesce(ru, 0)::DOUBLE / 100.0::DOUBLE AS received_before, coalesce(rs, 0) AS n_senders,
    (coalesce(ru, 0)::DOUBLE / 100.0::DOUBLE) / CASE WHEN su <> 0 THEN su::DOUBLE / 100.0::DOUBLE END AS received_to_sent, (us - rus) / 60000000.0::DOUBLE AS minutes_since_received
  FROM sn ASOF LEFT JOIN rc ON sn.source_phone = rc.phone AND sn.us > rc.rus)"""
_RULES_SQL = f"""tr AS (SELECT rid, ratio, {_PDIV.format('run', 'daily')} AS day_ratio, n_1h, n_24h FROM
  (SELECT *, {_RUN} AS run, {_trail('count(*)', HOUR_US)} AS n_1h, {_trail('count(*)', 24 * HOUR_US)} AS n_24h FROM rat)),
fl AS (SELECT rid, net.transaction_code, net.source_phone, net.partner_reference, ratio, zscore, coalesce(ratio > 1, FALSE) AS r1, coalesce(day_ratio > 1, FALSE) AS r2,
    coalesce(ratio BETWEEN 0.8::DOUBLE AND 1.0::DOUBLE AND n_24h >= 3, FALSE) AS r3, coalesce(n_1h > 80, FALSE) AS r4, coalesce(is_new AND max_ratio > 1.0, FALSE) AS r5,
    coalesce(hour(net.transaction_date) < 7 AND abs(zscore) > 3.0, FALSE) AS r6,
    coalesce(received_to_sent BETWEEN 0.9::DOUBLE AND 1.1::DOUBLE AND minutes_since_received BETWEEN 0 AND 30, FALSE) AS r7
  FROM net JOIN tr USING (rid) JOIN prior USING (rid)),
flags AS (SELECT *, r1::INT + r2::INT + r3::INT + r4::INT + r5::INT + r6::INT + r7::INT AS n_rules FROM fl)"""
_USED = f"""dy AS (SELECT source_phone AS entity, service_code AS code, CAST(transaction_date AS DATE) AS day, coalesce(sum(u), 0) AS u FROM clean WHERE transaction_status = 'VALIDATED' GROUP BY ALL),
mo AS (SELECT *, sum(u) OVER (PARTITION BY entity, code, date_trunc('month', day)) AS m FROM dy),
us0 AS (SELECT entity, mo.code, day, strftime(day, '%Y-%m') AS month, u::DOUBLE / 100.0::DOUBLE AS day_total, m::DOUBLE / 100.0::DOUBLE AS month_total, daily FROM mo LEFT JOIN lim ON mo.code = lim.code),
used AS (SELECT entity, code, day, month, day_total, month_total, {_PDIV.format('day_total', 'daily')} AS day_rate, {_PDIV.format('month_total', '(daily * 5)')} AS month_rate,
    daily - day_total AS day_left, daily * 5 - month_total AS month_left FROM us0)"""
_RANK = "CASE WHEN {0} >= 1 THEN 4 WHEN {0} >= 0.95::DOUBLE THEN 3 WHEN {0} >= 0.8::DOUBLE THEN 2 WHEN {0} >= 0.5::DOUBLE THEN 1 ELSE 0 END"
_ALERTS = f"""al AS (SELECT *, {_RANK.format('day_rate')} AS day_rank, {_RANK.format('month_rate')} AS month_rank FROM used),
alerts AS (SELECT *, greatest(day_rank, month_rank) AS worst_rank, ['none', '50%', '80%', '95%', '100%'][greatest(day_rank, month_rank) + 1] AS worst_level FROM al)"""
_EDGES = """e AS (SELECT transaction_code AS code, source_phone AS src, destination_phone AS dst, transaction_date AS ts, transaction_amount AS amount, us FROM clean
  WHERE source_phone IS NOT NULL AND coalesce(destination_phone, '') <> '' AND transaction_status = 'VALIDATED')"""
_PASS = """pt AS (SELECT source_phone AS node, count(*) AS n_rows, sum((coalesce(received_to_sent BETWEEN 0.7::DOUBLE AND 1.3::DOUBLE, FALSE) AND coalesce(minutes_since_received BETWEEN 0 AND 30, FALSE))::INT) AS n_quick, quantile_cont(minutes_since_received, 0.5) AS median_delay FROM net GROUP BY 1),
passing AS (SELECT *, n_quick::DOUBLE / n_rows AS quick_rate, n_quick::DOUBLE / n_rows * ln(1 + n_quick::DOUBLE) AS score FROM pt)"""
_CIRCUITS = """few AS (SELECT src, dst FROM e GROUP BY ALL HAVING count(*) <= 50),
ec AS (SELECT e.*, least(src, dst) AS a, greatest(src, dst) AS b FROM e JOIN few USING (src, dst)),
nx AS (SELECT a.code AS code_out, a.src, a.dst, n.code AS code_back, n.src AS src_back, row_number() OVER (PARTITION BY a.code ORDER BY n.us, n.code) AS rn
  FROM ec a JOIN ec n ON a.a = n.a AND a.b = n.b AND n.us > a.us AND n.us <= a.us + 604800000000),
circuits AS (SELECT code_out, code_back, src AS a, dst AS b FROM nx WHERE rn = 1 AND src_back = dst AND src <> dst)"""
_METRICS = """ms AS (SELECT source_phone AS phone, count(*) AS n_sent, coalesce(sum(u), 0)::DOUBLE / 100.0::DOUBLE AS sent,
    coalesce(sum(CAST(round(transaction_fees * 100) AS HUGEINT)), 0)::DOUBLE / 100.0::DOUBLE AS fees, count(DISTINCT service_code) AS n_services, count(DISTINCT CAST(transaction_date AS DATE)) AS n_days FROM clean GROUP BY 1),
mr AS (SELECT destination_phone AS phone, coalesce(sum(u), 0)::DOUBLE / 100.0::DOUBLE AS received FROM clean WHERE coalesce(destination_phone, '') <> '' GROUP BY 1),
mt AS (SELECT source_phone AS phone, count(DISTINCT destination_phone) AS n_targets FROM clean WHERE coalesce(destination_phone, '') <> '' GROUP BY 1),
metrics AS (SELECT phone, coalesce(n_sent, 0) AS n_sent, coalesce(sent, 0) AS sent, coalesce(fees, 0) AS fees, coalesce(n_services, 0) AS n_services, coalesce(n_days, 0) AS n_days,
    coalesce(received, 0) AS received, coalesce(n_targets, 0) AS n_targets, coalesce(n_sent, 0) > 0 AS is_sender FROM ms FULL JOIN mr USING (phone) LEFT JOIN mt USING (phone))"""


def _scaled(c: str) -> str:
    return f"CASE WHEN is_sender AND hi_{c} > lo_{c} THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({c} - lo_{c}) / (hi_{c} - lo_{c}))) ELSE 0.0::DOUBLE END"


_STATS = "st AS (SELECT " + ", ".join(f"min({c})::DOUBLE AS lo_{c}, quantile_cont({c}::DOUBLE, 0.99) AS hi_{c}" for c in ("sent", "n_targets", "fees")) + " FROM metrics WHERE is_sender)"
_RANKED = """rk AS (SELECT phone, (rank() OVER (ORDER BY received))::DOUBLE / count(*) OVER () AS rank_all,
    CASE WHEN is_sender THEN (rank() OVER (PARTITION BY is_sender ORDER BY sent))::DOUBLE / count(*) OVER (PARTITION BY is_sender) ELSE 0 END AS rank_senders FROM metrics)"""
_JUDGED = f"{CLEAN}, {_RATIO}, judged AS (SELECT transaction_code, transaction_status <> 'VALIDATED' AS label, greatest(0.0::DOUBLE, least(5.0::DOUBLE, coalesce(ratio, 0))) / 5.0::DOUBLE AS score FROM rat)"

# Lines cut at quotes: commas of every second piece stand between quotes.
_VALUES = """bd AS (SELECT * FROM raw_lines WHERE line_no IS DISTINCT FROM 1),
vs AS (SELECT line_id, line, CASE WHEN line IS NULL THEN [] ELSE list_transform(string_split(array_to_string(list_transform(string_split(line, '"'),
    lambda x, i: CASE WHEN i % 2 = 1 THEN replace(x, ',', chr(57344)) ELSE x END), '"'), chr(57344)),
    lambda x: CASE WHEN length(x) > 1 AND x[1:1] = '"' AND x[-1:] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) END AS v FROM bd)"""
_CELLS = f"""{_VALUES}, ce AS (SELECT line_id, unnest(range(len(v))) AS position, unnest(v) AS value FROM vs),
ct AS (SELECT position, value, count(*) AS n FROM ce GROUP BY ALL), fi AS (SELECT * FROM ct WHERE value <> '')"""
_CLASS = """CASE WHEN value = '' THEN 'EMPTY' WHEN regexp_full_match(value, '[0-9]{2}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') THEN 'DATE' WHEN regexp_full_match(value, 'TEL[0-9]+') THEN 'TEL'
    WHEN regexp_full_match(value, 'SERVICE_[0-9]+') THEN 'SERVICE' WHEN regexp_full_match(value, '[0-9]+') THEN 'INT' WHEN regexp_full_match(value, '[0-9]+[.][0-9]+') THEN 'FLOAT' ELSE 'OTHER' END"""
_PROFILED = f"""pp AS (SELECT position, sum(n)::BIGINT AS n_seen, coalesce(sum(n) FILTER (value <> ''), 0)::BIGINT AS n_nonempty, {', '.join(
    f"coalesce(sum(n) FILTER (t = '{t}'), 0)::BIGINT AS n_{t.lower()}" for t in ('DATE', 'TEL', 'SERVICE', 'INT', 'FLOAT', 'OTHER'))},
    count(*) FILTER (value <> '') AS n_distinct, count(*) FILTER (value <> '') > 5000 AS many_distinct FROM (SELECT *, {_CLASS} AS t FROM ct) GROUP BY 1),
sm AS (SELECT position, string_agg(value, '|' ORDER BY line_id) AS vals FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY line_id) AS rn FROM ce WHERE value <> '') WHERE rn <= 6 GROUP BY 1),
lw AS (SELECT position, string_agg(value, '|' ORDER BY value) AS vals FROM fi GROUP BY 1 HAVING count(*) <= 20),
bc AS (SELECT position, coalesce(sum(n) FILTER (value = '1'), 0)::BIGINT AS n_one, sum(n)::BIGINT AS n_filled FROM fi GROUP BY 1 HAVING count(*) FILTER (value NOT IN ('0', '1')) = 0)"""


def _merged(p: int) -> str:
    """A date and its fraction, in microseconds; the years 69 and up are of 1900."""
    d, f = f"coalesce(v[{p + 1}], '')", f"v[{p + 2}]"
    return (f"make_timestamp(epoch_us(CASE WHEN regexp_full_match({d}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{2}} ([01][0-9]|2[0-3]):[0-9]{{2}}:[0-9]{{2}}') THEN "
            f"try_cast(concat(CASE WHEN {d}[7:8] >= '69' THEN '19' ELSE '20' END, {d}[7:8], '-', {d}[4:5], '-', {d}[1:2], {d}[9:]) AS TIMESTAMP) END) + CAST(floor(coalesce(try_cast({f} AS BIGINT), 0) / 1000) AS BIGINT))")


_PROFILE = f"""WITH {CLEAN}, {_RATIO}, {_PRIOR}, {_NET}, {_RULES_SQL}, {_USED}, {_ALERTS}, {_METRICS},
  fg AS (SELECT source_phone AS phone, avg(abs(zscore)) AS mean_abs_z, avg(coalesce(ratio BETWEEN 0.8::DOUBLE AND 1.0::DOUBLE, FALSE)::INT) AS near_share, avg((trim(coalesce(partner_reference, '')) <> '')::INT) AS partner_share,
    {', '.join(f'avg({r}::INT) AS {r}_share' for r in ('r1', 'r2', 'r3', 'r4', 'r6', 'r7'))} FROM flags GROUP BY 1),
  se AS (SELECT destination_phone AS phone, count(DISTINCT source_phone) AS n_senders FROM clean WHERE coalesce(destination_phone, '') <> '' GROUP BY 1),
  h AS (SELECT entity AS phone, count(*) FILTER (worst_rank > 0) AS n_alerts, count(*) FILTER (worst_rank > 0 AND day >= (SELECT max(day) FROM alerts) - 30) AS n_recent, max(worst_rank) AS worst_rank FROM alerts GROUP BY 1)
  SELECT phone, tenure_days, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('n_sent', 'sent', 'fees', 'n_services', 'n_days', 'received', 'n_targets', 'n_senders', 'n_alerts', 'n_recent', 'worst_rank'))},
    {', '.join(f'round(coalesce({c}, 0), 9) AS {c}' for c in ('mean_abs_z', 'near_share', 'partner_share', *(f'{r}_share' for r in ('r1', 'r2', 'r3', 'r4', 'r6', 'r7'))))},
    round(coalesce(sent, 0) + coalesce(received, 0), 2) AS circulated, coalesce(n_sent, 0) > 0 AS is_sender, coalesce(n_days, 0) / greatest(tenure_days, 1) AS active_share
  FROM customer_phone_map LEFT JOIN metrics USING (phone) LEFT JOIN se USING (phone) LEFT JOIN fg USING (phone) LEFT JOIN h USING (phone)"""


def _among(c: str, mask: str) -> str:
    """A metric between its least and its 0.99 quantile among the rows of the mask."""
    lo, hi = f"(min({c}::DOUBLE) FILTER ({mask}) OVER ())", f"(quantile_cont({c}::DOUBLE, 0.99) FILTER ({mask}) OVER ())"
    return f"CASE WHEN {mask} AND {hi} > {lo} THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({c} - {lo}) / ({hi} - {lo}))) ELSE 0.0::DOUBLE END"


_COMPOSITE = f"""WITH cpf AS MATERIALIZED ({_PROFILE}),
xs AS (SELECT phone, {', '.join(f"{_among(c, 'is_sender')} AS x_{c}" for c in SCALED)}, {_among('n_senders', 'TRUE')} AS y_n_senders,
    CASE WHEN is_sender THEN (rank() OVER (PARTITION BY is_sender ORDER BY mean_abs_z))::DOUBLE / count(*) OVER (PARTITION BY is_sender) ELSE 0 END AS rank_z,
    CASE WHEN tenure_days IS NOT NULL THEN 1 - (rank() OVER (ORDER BY tenure_days NULLS LAST))::DOUBLE / count(tenure_days) OVER () ELSE 0 END AS rank_new FROM cpf),
cs AS (SELECT phone, greatest(rank_z, x_r4_share, x_r6_share) AS conduct, greatest(x_near_share, x_r3_share, x_r1_share, x_r2_share, x_partner_share) AS evasion,
    greatest(x_n_targets, x_r7_share, y_n_senders) AS network, least(1.0::DOUBLE, (x_n_alerts + 1.5::DOUBLE * x_n_recent + x_worst_rank) / 3) AS alerts, rank_new AS newness FROM xs)
SELECT phone, {', '.join(f'round({c}, 6) AS {c}' for c in ('conduct', 'evasion', 'network', 'alerts', 'newness'))},
  CAST(round_even(conduct * 300 + evasion * 250 + network * 200 + alerts * 150 + newness * 100, 0) AS INT) AS score FROM cs"""

SQL = {
    "field_counts": f"WITH {_VALUES} SELECT len(v) AS n_fields, count(*) AS n_lines FROM vs GROUP BY 1",
    "position_profile": f"WITH {_CELLS}, {_PROFILED} SELECT * FROM pp",
    "binary_candidates": f"WITH {_CELLS}, {_PROFILED} SELECT * FROM bc",
    "low_cardinality": f"WITH {_CELLS}, {_PROFILED} SELECT * FROM lw",
    "samples": f"WITH {_CELLS}, {_PROFILED} SELECT * FROM sm",
    "full_audit": f"""WITH {_CELLS}, {_PROFILED} SELECT position, n_seen, n_nonempty, round(100.0::DOUBLE * n_nonempty / n_seen, 4) AS pct_nonempty, n_distinct, many_distinct,
    bc.position IS NOT NULL AS "binary", sm.vals AS sample_values, lw.vals AS distinct_values FROM pp LEFT JOIN sm USING (position) LEFT JOIN lw USING (position) LEFT JOIN bc USING (position)""",
    "tolerant_load": f"""WITH {_VALUES} SELECT line_id, try_cast(v[1] AS BIGINT) AS transaction_code, coalesce(v[2], '') AS service_code, coalesce(v[3], '') AS transaction_status,
    {_merged(3)} AS transaction_date, {_merged(7)} AS request_date, {_merged(9)} AS response_date, coalesce(v[5], '') AS transaction_date__fraction_ns,
    try_cast(v[6] AS DOUBLE) AS transaction_amount, try_cast(v[14] AS DOUBLE) AS transaction_fees, coalesce(v[12], '') AS source_phone, coalesce(v[13], '') AS destination_phone,
    coalesce(v[19], '') AS partner_reference, coalesce(v[26], '') AS unclear_position_25 FROM vs""",
    "typed_dates": """SELECT leg_id, loaded_at, make_timestamp(epoch_us(CASE WHEN regexp_full_match(posted_date__date_part, '[0-9]{2}/[0-9]{2}/[0-9]{2} ([01][0-9]|2[0-3]):[0-9]{2}:[0-9]{2}') THEN
  try_cast(concat(CASE WHEN posted_date__date_part[7:8] >= '69' THEN '19' ELSE '20' END, posted_date__date_part[7:8], '-', posted_date__date_part[4:5], '-', posted_date__date_part[1:2], posted_date__date_part[9:]) AS TIMESTAMP) END)
  + coalesce(posted_date__fraction_ns, 0) // 1000) AS posted_at FROM ledger_legs""",
    "validators_report": """WITH a AS (SELECT count(*) - count(DISTINCT transaction_code) - max((transaction_code IS NULL)::INT) AS unique_code, count(*) FILTER (transaction_amount > 10000000) AS bounded_amount,
    count(*) FILTER (transaction_code IS NULL) AS filled_transaction_code, count(*) FILTER (service_code IS NULL) AS filled_service_code, count(*) FILTER (transaction_date IS NULL) AS filled_transaction_date,
    count(*) FILTER (source_phone IS NULL) AS filled_source_phone, (SELECT count(DISTINCT service_code) FROM transactions WHERE service_code NOT IN (SELECT service_code FROM service_thresholds)) AS known_category FROM transactions),
  u AS (UNPIVOT a ON COLUMNS(*) INTO NAME check_name VALUE failures) SELECT check_name, failures, failures = 0 AS passed FROM u""",
    "quarantined": f"""WITH {LATEST_SQL} SELECT transaction_code, CASE WHEN coalesce(year(transaction_date) >= 2020, FALSE) THEN 'amount' ELSE 'date' END AS reason FROM held
  WHERE NOT (coalesce(year(transaction_date) >= 2020, FALSE) AND coalesce(transaction_amount <= 10000000, FALSE))""",
    "dedup_first": """SELECT transaction_code, transaction_status, transaction_fees, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY transaction_code ORDER BY loaded_at NULLS LAST, transaction_status NULLS LAST, transaction_fees NULLS LAST) AS rn FROM transactions) WHERE rn = 1""",
    "functional_duplicates": f"""WITH {CLEAN} SELECT transaction_code, coalesce(us - lag(us) OVER (PARTITION BY source_phone, destination_phone, transaction_amount ORDER BY us, transaction_code) <= 600000000, FALSE) AS is_duplicate FROM clean""",
    "clean_flags": f"""WITH {CLEAN} SELECT transaction_code, upper(trim(service_code)) AS service_code, upper(trim(transaction_status)) AS transaction_status, upper(trim(transaction_status)) = 'VALIDATED' AS is_valid, trim(coalesce(partner_reference, '')) <> '' AS has_partner FROM clean""",
    "phone_activity": f"""WITH {CLEAN}, s AS (SELECT source_phone AS phone, min(transaction_date) AS f, max(transaction_date) AS l, count(*) AS n, sum(u) AS u FROM clean WHERE coalesce(source_phone, '') <> '' GROUP BY 1),
  d AS (SELECT destination_phone AS phone, min(transaction_date) AS f, max(transaction_date) AS l, count(*) AS n, sum(u) AS u FROM clean WHERE coalesce(destination_phone, '') <> '' GROUP BY 1),
  b AS (SELECT phone, least(s.f, d.f) AS first_seen, greatest(s.l, d.l) AS last_seen, coalesce(s.n, 0) AS n_sent, coalesce(d.n, 0) AS n_received, coalesce(s.u, 0)::DOUBLE / 100.0::DOUBLE AS total_sent, coalesce(d.u, 0)::DOUBLE / 100.0::DOUBLE AS total_received FROM s FULL JOIN d USING (phone))
  SELECT *, (epoch_us(last_seen) - epoch_us(first_seen)) // 86400000000 AS tenure_days, CASE WHEN total_sent <> 0 THEN total_received / total_sent END AS received_to_sent FROM b""",
    "threshold_features": f"WITH {CLEAN}, {_RATIO} SELECT transaction_code, ratio, coalesce(ratio > 1, FALSE) AS above, distance FROM rat",
    "daily_cumulative": f"WITH {CLEAN} SELECT transaction_code, {_RUN} AS day_total FROM clean",
    "velocity": f"WITH {CLEAN} SELECT transaction_code, " + ", ".join(f"{_trail('count(*)', us)} AS n_{w}, ({_trail('sum(u)', us)})::DOUBLE / 100.0::DOUBLE AS sum_{w}" for w, us in WINDOWS.items()) + " FROM clean",
    "behavioral_stats": f"WITH {CLEAN}, {_PRIOR} SELECT transaction_code, n_prior, max_prior, " + "mean_prior, std_prior, zscore, max_ratio, days_since FROM prior",
    "prior_median": f"WITH {CLEAN}, m AS (SELECT transaction_code, transaction_amount, quantile_cont(transaction_amount, 0.5) {_P} AS median_prior FROM clean) SELECT transaction_code, median_prior, {_PDIV.format('transaction_amount', 'median_prior')} AS median_ratio FROM m",
    "new_beneficiary": f"WITH {CLEAN} SELECT transaction_code, {_FIRST} AS is_new FROM clean",
    "network_causal": f"WITH {CLEAN}, {_NET} SELECT transaction_code, sent_before, received_before, n_targets, n_senders, received_to_sent, minutes_since_received FROM net",
    "rule_flags": f"WITH {CLEAN}, {_RATIO}, {_PRIOR}, {_NET}, {_RULES_SQL} SELECT transaction_code, r1, r2, r3, r4, r5, r6, r7, n_rules, n_rules >= 2 AS is_suspect FROM flags",
    "flagged_amount": f"WITH {CLEAN}, {_RATIO}, {_PRIOR}, {_NET}, {_RULES_SQL} SELECT count(*) AS n, coalesce(sum(u), 0)::DOUBLE / 100.0::DOUBLE AS amount FROM flags JOIN clean USING (rid) WHERE n_rules >= 3",
    "clean_transactions": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY transaction_code ORDER BY loaded_at NULLS LAST, transaction_status NULLS LAST, transaction_fees NULLS LAST) AS rn,
    epoch_us(transaction_date) AS us FROM transactions WHERE year(transaction_date) >= 2020 AND transaction_amount <= 10000000)
  SELECT transaction_code, upper(trim(service_code)) AS service_code, upper(trim(transaction_status)) AS transaction_status, coalesce(upper(trim(transaction_status)) = 'VALIDATED', FALSE) AS is_valid,
    trim(coalesce(partner_reference, '')) <> '' AS has_partner,
    coalesce(us - lag(us) OVER (PARTITION BY source_phone, destination_phone, transaction_amount ORDER BY us, transaction_code) <= 600000000, FALSE) AS is_duplicate FROM k WHERE rn = 1""",
    "offending_amounts": "SELECT transaction_code FROM (SELECT DISTINCT transaction_code FROM transactions WHERE transaction_amount > 10000000) ORDER BY 1 LIMIT 200",
    "unknown_categories": "SELECT DISTINCT service_code FROM staged_rows WHERE service_code <> '' AND service_code NOT IN (SELECT service_code FROM service_thresholds)",
    "worst_alerts": f"WITH {CLEAN}, {_USED}, {_ALERTS} SELECT entity, code, day, worst_level FROM alerts WHERE worst_rank > 0 ORDER BY worst_rank DESC, day DESC, entity NULLS FIRST, code NULLS FIRST LIMIT 50",
    "report_customers": f"""WITH {CLEAN}, {_USED}, {_ALERTS}, {_METRICS}, most AS (SELECT phone FROM metrics WHERE phone IS NOT NULL ORDER BY sent DESC, phone LIMIT 100),
  wa AS (SELECT entity FROM (SELECT * FROM alerts WHERE worst_rank > 0 ORDER BY worst_rank DESC, day DESC, entity NULLS FIRST, code NULLS FIRST LIMIT 50) WHERE entity IS NOT NULL)
  SELECT phone, 'amount' AS why FROM most UNION ALL SELECT DISTINCT entity, 'alert' FROM wa WHERE entity NOT IN (SELECT phone FROM most)""",
    "customer_profile": _PROFILE,
    "composite_scores": _COMPOSITE,
    "leakage_folds": f"""WITH {CLEAN}, b AS (SELECT min(us) AS lo, max(us) AS hi, max(us) - CAST(floor((max(us) - min(us)) * 0.05::DOUBLE) AS BIGINT) AS hold FROM clean),
  s AS (SELECT transaction_code, us, lo, hold, (hold - lo) // 4 AS step, fold FROM clean, b, (SELECT unnest([1, 2, 3]) AS fold)),
  f AS (SELECT *, us < lo + step * fold - 604800000000 AS train, us >= lo + step * fold AND us < CASE WHEN fold < 3 THEN lo + step * (fold + 1) ELSE hold END AS valid FROM s)
  SELECT fold, count(*) FILTER (train) AS n_train, count(*) FILTER (valid) AS n_valid, (min(us) FILTER (valid) - max(us) FILTER (train)) / 86400000000.0::DOUBLE AS gap_days, 0 AS shared_codes,
    coalesce((min(us) FILTER (valid) - max(us) FILTER (train)) / 86400000000.0::DOUBLE >= 7, TRUE) AS passed FROM f GROUP BY 1""",
    "suspicion_histogram": f"WITH {CLEAN}, {_RATIO}, {_PRIOR}, {_NET}, {_RULES_SQL} SELECT n_rules, count(*) AS n FROM flags GROUP BY 1",
    "budget_consumption": f"WITH {CLEAN}, {_USED} SELECT * FROM used",
    "budget_alerts": f"WITH {CLEAN}, {_USED}, {_ALERTS} SELECT entity, code, day, day_rank, month_rank, worst_level FROM alerts",
    "alert_history": f"""WITH {CLEAN}, {_USED}, {_ALERTS}, h AS (SELECT entity, count(*) FILTER (worst_rank > 0) AS n_alerts, count(*) FILTER (worst_rank > 0 AND day >= (SELECT max(day) FROM alerts) - 30) AS n_recent, max(worst_rank) AS worst_rank FROM alerts GROUP BY 1)
  SELECT *, ['none', '50%', '80%', '95%', '100%'][worst_rank + 1] AS worst_level FROM h""",
    "budget_latest": f"WITH {CLEAN}, {_USED} SELECT entity, code, day, day_total, month_total FROM (SELECT *, row_number() OVER (PARTITION BY entity, code ORDER BY day DESC) AS rn FROM used) WHERE rn = 1",
    "edgelist": f"WITH {CLEAN}, {_EDGES} SELECT code, src, dst, ts, amount FROM e",
    "graph_sizes": f"WITH {CLEAN}, {_EDGES} SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS nodes, count(*) AS edges FROM e",
    "fan_in": f"WITH {CLEAN}, {_EDGES} SELECT dst AS node, count(DISTINCT src) AS fan_in FROM e GROUP BY 1",
    "fan_out_top": f"WITH {CLEAN}, {_EDGES} SELECT src AS node, count(DISTINCT dst) AS fan_out FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200",
    "pass_through": f"WITH {CLEAN}, {_NET}, {_PASS} SELECT node, n_rows, n_quick, quick_rate, round(median_delay, 6) AS median_delay, round(score, 6) AS score FROM passing",
    "closed_circuits": f"WITH {CLEAN}, {_EDGES}, {_CIRCUITS} SELECT * FROM circuits",
    "graph_features": f"""WITH {CLEAN}, {_NET}, {_EDGES}, {_PASS}, {_CIRCUITS}, fi AS (SELECT dst AS node, count(DISTINCT src) AS fan_in FROM e GROUP BY 1), fu AS (SELECT src AS node, count(DISTINCT dst) AS fan_out FROM e GROUP BY 1),
  lo AS (SELECT node, count(*) AS n_circuits FROM (SELECT a AS node FROM circuits UNION ALL SELECT b FROM circuits) GROUP BY 1)
  SELECT node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(n_quick, 0) AS n_quick, round(coalesce(score, 0), 6) AS score, coalesce(n_circuits, 0) AS n_circuits, coalesce(n_circuits, 0) > 0 AS in_circuit
  FROM fi FULL JOIN fu USING (node) LEFT JOIN passing USING (node) LEFT JOIN lo USING (node)""",
    "ego_edges": f"""WITH {CLEAN}, {_NET}, {_EDGES}, {_PASS}, {_CIRCUITS},
  ce AS MATERIALIZED (SELECT node FROM passing WHERE n_quick >= 3 AND node IS NOT NULL ORDER BY score DESC, node LIMIT 8),
  cp AS (SELECT centre, node, count(*) AS n FROM (SELECT src AS centre, dst AS node FROM e WHERE src IN (SELECT node FROM ce) UNION ALL SELECT dst, src FROM e WHERE dst IN (SELECT node FROM ce)) GROUP BY ALL),
  nb AS (SELECT node FROM (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY n DESC, node) AS rn FROM cp) WHERE rn <= 2 AND node NOT IN (SELECT node FROM ce)),
  lc AS MATERIALIZED (SELECT a, b FROM circuits JOIN e ON e.code = code_out ORDER BY amount DESC, code_out LIMIT 6),
  seeds AS (SELECT node FROM ce UNION SELECT node FROM nb UNION SELECT a FROM lc UNION SELECT b FROM lc)
  SELECT src, dst, count(*) AS n FROM e WHERE src <> dst AND src IN (FROM seeds) AND dst IN (FROM seeds) GROUP BY ALL ORDER BY src, dst LIMIT 300""",
    "customer_metrics": f"WITH {CLEAN}, {_METRICS} SELECT * FROM metrics",
    "norm_rank": f"WITH {CLEAN}, {_METRICS}, {_RANKED} SELECT phone, rank_all, rank_senders FROM rk",
    "norm_scaled": f"""WITH {CLEAN}, {_METRICS}, {_STATS} SELECT phone, round({_scaled('sent')}, 6) AS scaled_sent, round({_scaled('n_targets')}, 6) AS scaled_targets,
    round(CASE WHEN hi > lo THEN 1 - greatest(0.0::DOUBLE, least(1.0::DOUBLE, (received - lo) / (hi - lo))) ELSE 1 END, 6) AS scaled_received FROM metrics, st, (SELECT min(received) AS lo, quantile_cont(received, 0.99) AS hi FROM metrics)""",
    "weighted_scores": f"""WITH {CLEAN}, {_METRICS}, {_STATS}, {_RANKED}, x AS (SELECT phone, rank_senders AS a, {_scaled('fees')} AS b, {_scaled('n_targets')} AS c FROM metrics JOIN rk USING (phone), st),
  y AS (SELECT *, CAST(round_even(a * 500 + b * 300 + c * 200, 0) AS INT) AS score FROM x)
  SELECT phone, score, CASE WHEN score BETWEEN 0 AND 299 THEN 'low' WHEN score BETWEEN 300 AND 599 THEN 'middle' WHEN score BETWEEN 600 AND 1000 THEN 'high' ELSE 'none' END AS band,
  array_to_string(list_transform(list_sort([{{'k': -a, 'i': 0, 't': 'volume'}}, {{'k': -b, 'i': 1, 't': 'fees'}}, {{'k': -c, 'i': 2, 't': 'reach'}}]), lambda s: s.t), ' ; ') AS because FROM y""",
    "score_reasons": f"""WITH {CLEAN}, {_METRICS}, sd AS (SELECT phone, sent, received, rank() OVER (ORDER BY sent)::DOUBLE / count(*) OVER () AS a, rank() OVER (ORDER BY received)::DOUBLE / count(*) OVER () AS b FROM metrics WHERE is_sender)
  SELECT phone, array_to_string(list_transform(list_sort([
    {{'k': -a, 'i': 0, 't': concat('sent ', format('{{:,}}', round_even(sent, 0)::BIGINT), ' (above ', round_even(a * 100, 0)::INT, ' %)')}},
    {{'k': -b, 'i': 1, 't': concat('received ', format('{{:,}}', round_even(received, 0)::BIGINT), ' (above ', round_even(b * 100, 0)::INT, ' %)')}}]), lambda s: s.t), ' ; ') AS because FROM sd""",
    "service_hour_heatmap": f"WITH {CLEAN} SELECT service_code, hour(transaction_date) AS hour, count(*) AS n, count(*) FILTER (transaction_status <> 'VALIDATED') AS n_failed, round(count(*) FILTER (transaction_status <> 'VALIDATED')::DOUBLE / count(*), 4) AS failed_share FROM clean GROUP BY 1, 2",
    "monthly_trend": f"WITH {CLEAN} SELECT strftime(transaction_date, '%Y-%m') AS month, count(*) AS n, sum(u)::DOUBLE / 100.0::DOUBLE AS total FROM clean GROUP BY 1",
    "status_counts": f"WITH {LATEST_SQL} SELECT transaction_status, count(*) AS n FROM held GROUP BY 1",
    "kpis": f"WITH {CLEAN} SELECT count(*) AS n, count(*) FILTER (transaction_status = 'VALIDATED') AS n_valid, count(DISTINCT source_phone) AS n_senders, sum(u)::DOUBLE / 100.0::DOUBLE AS total, sum(u) FILTER (transaction_status = 'VALIDATED')::DOUBLE / 100.0::DOUBLE AS total_valid FROM clean",
    "largest": f"WITH {CLEAN} SELECT transaction_code, transaction_amount FROM clean ORDER BY transaction_amount DESC, transaction_code LIMIT 50",
    "newest": f"WITH {CLEAN} SELECT transaction_code, transaction_date FROM clean ORDER BY transaction_date DESC, transaction_code LIMIT 50",
    "temporal_split": f"""WITH {CLEAN}, b AS (SELECT min(us) AS lo, max(us) AS hi, max(us) - CAST(floor((max(us) - min(us)) * 0.05::DOUBLE) AS BIGINT) AS hold FROM clean),
  s AS (SELECT us, lo, hold, (hold - lo) // 4 AS step FROM clean, b),
  f AS (SELECT us >= hold AS is_holdout, """ + ", ".join(
        f"us < lo + step * {i} - 604800000000 AS train_{i}, us >= lo + step * {i} AND us < {f'lo + step * {i + 1}' if i < 3 else 'hold'} AS valid_{i}" for i in (1, 2, 3)) + """ FROM s)
  SELECT *, count(*) AS n FROM f GROUP BY ALL""",
    "baseline_score": f"WITH {_JUDGED} SELECT * FROM judged",
    "average_precision": f"""WITH {_JUDGED}, g AS (SELECT score, sum(label::INT) AS p, count(*) AS n FROM judged GROUP BY 1), c AS (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
  SELECT round(sum(p * cp::DOUBLE / cn) / sum(p), 9) AS average_precision FROM c""",
    "baseline_folds": f"""WITH {_JUDGED.replace("SELECT transaction_code, transaction_status <>", "SELECT us, transaction_status <>")}, b AS (SELECT min(us) AS lo, max(us) AS hi, max(us) - CAST(floor((max(us) - min(us)) * 0.05::DOUBLE) AS BIGINT) AS hold FROM judged),
  s AS (SELECT judged.*, lo, hold, (hold - lo) // 4 AS step, fold FROM judged, b, (SELECT unnest([1, 2, 3]) AS fold)),
  g AS (SELECT fold, score, sum(label::INT) AS p, count(*) AS n FROM s WHERE us >= lo + step * fold AND us < CASE WHEN fold < 3 THEN lo + step * (fold + 1) ELSE hold END GROUP BY 1, 2),
  c AS (SELECT fold, p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
  a AS (SELECT fold, round(sum(p * cp::DOUBLE / cn) / sum(p), 9) AS average_precision FROM c GROUP BY 1)
  SELECT fold, average_precision, round(avg(average_precision) OVER (), 6) AS mean, round(stddev_pop(average_precision) OVER (), 6) AS deviation FROM a""",
    "precision_recall": f"""WITH {_JUDGED}, t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold), x AS (SELECT threshold, count(*) FILTER (score >= threshold) AS alerts, coalesce(sum(label::INT) FILTER (score >= threshold), 0) AS true_positives, sum(label::INT) AS positives FROM judged, t GROUP BY 1),
  y AS (SELECT *, CASE WHEN alerts > 0 THEN true_positives::DOUBLE / alerts ELSE 0 END AS precision, CASE WHEN positives > 0 THEN true_positives::DOUBLE / positives ELSE 0 END AS recall FROM x)
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM y""",
}

QUERIES = {f.__name__: f for f in (
    typed_dates, validators_report, quarantined, dedup_first, functional_duplicates, clean_flags, phone_activity, threshold_features, daily_cumulative,
    velocity, behavioral_stats, prior_median, new_beneficiary, network_causal, rule_flags, suspicion_histogram, budget_consumption, budget_alerts,
    alert_history, budget_latest, edgelist, graph_sizes, fan_in, fan_out_top, pass_through, closed_circuits, graph_features, ego_edges, customer_metrics,
    norm_rank, norm_scaled, weighted_scores, service_hour_heatmap, monthly_trend, status_counts, kpis, largest, newest, temporal_split, baseline_score,
    average_precision, precision_recall, lr_scores, gbt_scores, field_counts, position_profile, binary_candidates, low_cardinality,
    samples, full_audit, tolerant_load, clean_transactions, offending_amounts, unknown_categories, flagged_amount, worst_alerts, report_customers,
    customer_profile, composite_scores, score_reasons, baseline_folds, leakage_folds, fold_metrics)}
