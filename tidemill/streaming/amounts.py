"""Structured Streaming variants: daily amounts with late data, and level alerts on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.exprs import label, level, pdiv
from tidemill.operators.budget import LEVEL_NAMES, LEVELS
from tidemill.operators.redelivery import fixed_point


def once(stream: DataFrame, code: str, ts: str, late: str) -> DataFrame:
    """Each code once, among rows no later than the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([code])


def daily_amounts(stream: DataFrame, entity: Sequence[str], ts: str, amount: str, late: str = "2 days", decimals: int = 2) -> DataFrame:
    """(entity..., day, units, n) of a stream: a day is updated while rows for it may come."""
    days = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    units = fixed_point(amount, decimals)
    agg = days.groupBy(F.window(ts, "1 day"), *entity).agg(F.coalesce(F.sum(units), F.lit(0)).alias("units"), F.count(units).alias("n"))
    return agg.select(*entity, F.to_date("window.start").alias("day"), "units", "n")


def level_alerts(daily: DataFrame, limits: DataFrame, code: str, limit: str, decimals: int = 2) -> DataFrame:
    """The level that each entity's day has reached so far; ``limits`` is a static table."""
    dims = limits.select(F.col("__code"), F.col(limit).alias("__limit"))
    joined = daily.join(dims, F.col(code) == F.col("__code"), "left")
    total = F.col("units") / float(10**decimals)
    rank = level(pdiv(total, F.col("__limit")), LEVELS)
    return joined.withColumn("day_total", total).withColumn("level", label(rank, LEVEL_NAMES)).drop("__code", "__limit", "units")
