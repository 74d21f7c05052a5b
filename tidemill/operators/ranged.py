"""Exact ranks and quantiles of groups without sorting a group in one task.

Rows are counted per distinct value first; the values are cut into ranges across all
groups, and of each range only its totals are carried on. A window runs over a range, or over
one row for each range of a group. NULL keys are one group; NULL values are no values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import materialize


def same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    """Whether all keys are equal, NULL to NULL."""
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def counts_below(per: DataFrame, ids: Sequence[str], value: str, count: str) -> DataFrame:
    """The counts of distinct values with ``__below``, how many rows of the group have a lesser one, and ``__all``, its rows.

    The cut into ranges is written down, as both uses must see the same one.
    """
    ranged = materialize(per.repartitionByRange(*ids, value).withColumn("__p", F.spark_partition_id()), "ranged")
    carried = Window.partitionBy(*ids).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    keys = [f"__id{i}" for i in range(len(ids))]
    parts = ranged.groupBy(*ids, "__p").agg(F.sum(count).alias("__pn")).select(
        *[F.col(c).alias(k) for c, k in zip(ids, keys)], F.col("__p").alias("__q"),
        F.coalesce(F.sum("__pn").over(carried), F.lit(0)).alias("__base"), F.sum("__pn").over(Window.partitionBy(*ids)).alias("__all"))
    w = Window.partitionBy(*ids, "__p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__p") == F.col("__q")
    if ids:
        same = same & same_keys(ids, keys)
    placed = ranged.withColumn("__r", F.coalesce(F.sum(count).over(w), F.lit(0))).join(parts, same)
    return placed.select(*per.columns, (F.col("__base") + F.col("__r")).alias("__below"), "__all")


def group_quantiles(per: DataFrame, ids: Sequence[str], value: str, count: str, q: float, name: str) -> DataFrame:
    """(ids..., name): the exact ``q`` quantile of each group, linear between neighbours, from counts of distinct values."""
    placed = counts_below(per, ids, value, count)
    at = (F.col("__all") - 1) * F.lit(float(q))
    covers = lambda k: F.max(F.when((F.col("__below") <= k) & (F.col("__below") + F.col(count) > k), F.col(value)))
    two = placed.groupBy(*ids).agg(covers(F.floor(at)).alias("__lo"), covers(F.ceil(at)).alias("__hi"), F.max(at - F.floor(at)).alias("__f"))
    x = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise(F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f"))
    return two.select(*ids, x.alias(name))
