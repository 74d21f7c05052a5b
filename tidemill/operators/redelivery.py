"""Re-delivered rows: keep the row that holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str, delivered: str, columns: Sequence[str]) -> DataFrame:
    """One row per ``key``: the one with the latest ``delivered``; equal rows count once.

    ``columns`` are the columns to carry besides the key (the rest is pruned from the
    scan). Ties of ``delivered`` are broken by the values of ``columns``, so the result
    does not depend on the order of rows. A NULL key identifies nothing: such rows
    stay, equal ones once; they are spread by their content, so no task gets all of
    them. The partial group limit that Catalyst places before the exchange removes
    repeated rows on the map side. Empty in, empty out.
    """
    kept = [key, delivered, *[c for c in columns if c not in (key, delivered)]]
    rows = df.select(*kept)
    content = F.when(F.col(key).isNull(), F.xxhash64(*kept))
    order = [F.col(delivered).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in kept[2:]]]
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key, content).orderBy(*order)))
    return ranked.filter("__rn = 1").drop("__rn")


def fixed_point(amount: str, decimals: int):
    """The amount as a whole number of its smallest unit: sums are exact in any order.

    NULL, NaN, infinite and unrepresentable amounts (beyond 9e15 units) give NULL.
    """
    units = F.round(F.col(amount).cast("double") * float(10**decimals))
    return F.when(F.abs(units) <= 9e15, units).cast("bigint")
