"""Amounts per entity and period against limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.exprs import label, level, micros, pdiv
from tidemill.operators.history import DAY_US, Carried, before
from tidemill.operators.redelivery import fixed_point

LEVELS = (0.5, 0.8, 0.95, 1.0)
LEVEL_NAMES = ("none", "50%", "80%", "95%", "100%")


def limits(table: DataFrame, code: str, columns: Sequence[str]) -> DataFrame:
    """The limits by upper-case trimmed code; a small dimension that Catalyst broadcasts by its size."""
    return table.select(F.upper(F.trim(code)).alias("__code"), *columns)


def ratio_to_limit(rows: DataFrame, dims: DataFrame, code: str, amount: str, limit: str) -> DataFrame:
    """``ratio``, ``above`` and ``distance`` of each row's amount to its code's limit; NULL without one."""
    dims = dims.select("__code", F.col(limit).alias("__limit"))
    joined = rows.join(dims, F.col(code) == F.col("__code"), "left")
    ratio = pdiv(F.col(amount), F.col("__limit"))
    return (joined.withColumn("ratio", ratio).withColumn("above", F.coalesce(F.col("ratio") > 1, F.lit(False)))
            .withColumn("distance", F.col("__limit") - F.col(amount)).drop("__code", "__limit"))


def running_day_total(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, amount: str, counts: Column, name: str, decimals: int = 2, stretch_us: int = DAY_US) -> DataFrame:
    """``name``: the running total of the keys' amounts on the day, this row included; rows not counted add 0.

    One task orders a day of the keys, or with a shorter ``stretch_us`` so much of it.
    """
    units = F.when(counts, F.coalesce(fixed_point(amount, decimals), F.lit(0))).otherwise(0)
    if stretch_us < DAY_US:
        dated = rows.withColumn("__date", F.to_date(ts))
        got = before(dated, [*keys, "__date"], ts, tie, {name: Carried(units)}, including=True, stretch_us=stretch_us)
        return got.withColumn(name, F.col(name) / float(10**decimals)).drop("__date")
    day = Window.partitionBy(*keys, F.to_date(ts)).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(units).over(day) / float(10**decimals))


def consumption(rows: DataFrame, dims: DataFrame, entity: str, code: str, ts: str, amount: str, limit: str, per_month: float = 30, decimals: int = 2) -> DataFrame:
    """Per entity, code and day: the day's and its month's totals, their shares of the limit and what remains.

    Rows are aggregated once, by day; months add up days.
    """
    unit = float(10**decimals)
    daily = rows.groupBy(F.col(entity).alias("entity"), F.col(code).alias("code"), F.to_date(ts).alias("day")).agg(
        F.coalesce(F.sum(fixed_point(amount, decimals)), F.lit(0)).alias("__u"))
    month = Window.partitionBy("entity", "code", F.date_trunc("month", "day"))
    both = daily.withColumn("__m", F.sum("__u").over(month))
    joined = both.join(dims.select("__code", F.col(limit).alias("__limit")), F.col("code") == F.col("__code"), "left")
    day_total, month_total = F.col("__u") / unit, F.col("__m") / unit
    return joined.select(
        "entity", "code", "day", F.date_format("day", "yyyy-MM").alias("month"), day_total.alias("day_total"), month_total.alias("month_total"),
        pdiv(day_total, F.col("__limit")).alias("day_rate"), pdiv(month_total, F.col("__limit") * per_month).alias("month_rate"),
        (F.col("__limit") - day_total).alias("day_left"), (F.col("__limit") * per_month - month_total).alias("month_left"))


def alerts(used: DataFrame, bounds: Sequence[float] = LEVELS, names: Sequence[str] = LEVEL_NAMES) -> DataFrame:
    """The levels that day and month reach, and the more severe of them."""
    d, m = level(F.col("day_rate"), bounds), level(F.col("month_rate"), bounds)
    return (used.withColumn("day_rank", d).withColumn("month_rank", m).withColumn("worst_rank", F.greatest("day_rank", "month_rank"))
            .withColumn("worst_level", label(F.col("worst_rank"), names)))


def alert_history(alerted: DataFrame, recent_days: int = 30, names: Sequence[str] = LEVEL_NAMES) -> DataFrame:
    """Per entity: alerts, alerts of the last days (counted from the latest day of all), the worst level."""
    last = alerted.agg(F.max("day").alias("__last"))  # one row
    hit = F.col("worst_rank") > 0
    recent = hit & (F.col("day") >= F.date_sub(F.col("__last"), recent_days))
    return (alerted.crossJoin(last).groupBy("entity").agg(
        F.count(F.when(hit, 1)).alias("n_alerts"), F.count(F.when(recent, 1)).alias("n_recent"), F.max("worst_rank").alias("worst_rank"))
        .withColumn("worst_level", label(F.col("worst_rank"), names)))


def latest_per_key(rows: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Of every key the row with the greatest ``by``, by aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("__r"))
    return best.select(*keys, "__r.*").select(*rows.columns)


def phone_activity(rows: DataFrame, source: str, target: str, ts: str, amount: str, decimals: int = 2) -> DataFrame:
    """Per phone: first and last seen, days between, counts and totals sent and received, received to sent."""
    units = fixed_point(amount, decimals)
    unit = float(10**decimals)

    def side(c: str, out: str) -> DataFrame:
        return rows.filter(F.coalesce(F.col(c), F.lit("")) != "").groupBy(F.col(c).alias("phone")).agg(
            F.min(ts).alias(f"first_{out}"), F.max(ts).alias(f"last_{out}"), F.count(F.lit(1)).alias(f"n_{out}"), F.sum(units).alias(f"__u_{out}"))

    both = side(source, "sent").join(side(target, "received"), "phone", "full")
    first, last = F.least("first_sent", "first_received"), F.greatest("last_sent", "last_received")
    out = both.select("phone", first.alias("first_seen"), last.alias("last_seen"),
                      *[F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in ("sent", "received")],
                      *[(F.coalesce(f"__u_{s}", F.lit(0)) / unit).alias(f"total_{s}") for s in ("sent", "received")])
    days = F.floor((micros("last_seen") - micros("first_seen")) / F.lit(86_400_000_000))
    return out.withColumn("tenure_days", days).withColumn(
        "received_to_sent", F.when(F.col("total_sent") != 0, F.col("total_received") / F.col("total_sent")))

