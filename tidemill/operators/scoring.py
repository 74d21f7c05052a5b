"""Ranks, scales and weighted scores over a table of metrics, and rules as named predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.exprs import holds
from tidemill.operators.ranged import counts_below, group_quantiles


def percent_rank_min(rows: DataFrame, value: str, name: str, mask: Column | None = None, reverse: bool = False) -> DataFrame:
    """``name``: the least rank of the value among the masked rows over their number; 0 outside the mask.

    Ranks come from counts per distinct value. NULL values have rank NULL.
    """
    inside = F.lit(True) if mask is None else holds(mask)
    per = rows.filter(inside & F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    rank = counts_below(per, [], "__v", "__n").select("__v", (F.col("__below") + 1).alias("__rank"))
    total = rows.agg(F.count(F.when(inside & F.col(value).isNotNull(), 1)).alias("__total"))  # one row
    joined = rows.join(rank, F.col(value) == F.col("__v"), "left").crossJoin(total)
    share = F.col("__rank") / F.col("__total")
    share = 1 - share if reverse else share
    return joined.withColumn(name, F.when(inside, share).otherwise(F.lit(0.0))).select(*rows.columns, name)


def quantiles(rows: DataFrame, values: Sequence[str], q: float) -> DataFrame:
    """One row: the exact ``q`` quantile of each column, linear between neighbours; NULL without values."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(values)]))
    per = rows.select(cells.alias("x")).select("x.i", "x.v").filter("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    found = group_quantiles(per, ["i"], "v", "n", q, "x")
    return found.agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(f"__hi_{i}") for i in range(len(values))])


def scale_min_max(rows: DataFrame, values: Mapping[str, str], mask: Column | None = None, top: float = 0.99, reverse: bool = False) -> DataFrame:
    """Each value (result name -> column) between its least and its ``top`` quantile as 0 to 1, clipped; 0 outside the mask or without a range."""
    inside = F.lit(True) if mask is None else holds(mask)
    masked = rows.filter(inside)
    stats = masked.agg(*[F.min(c).alias(f"__lo_{i}") for i, c in enumerate(values.values())]).crossJoin(quantiles(masked, list(values.values()), top))  # one row each
    out = {}
    for i, (n, c) in enumerate(values.items()):
        lo, hi = F.col(f"__lo_{i}"), F.col(f"__hi_{i}")
        x = F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - lo) / (hi - lo)))).otherwise(0.0)
        out[n] = F.when(inside, F.coalesce(1 - x if reverse else x, F.lit(0.0))).otherwise(F.lit(0.0))
    return rows.crossJoin(stats).withColumns(out).select(*rows.columns, *values)


def composite(rows: DataFrame, parts: Mapping[str, tuple[str, Mapping[str, float]]]) -> DataFrame:
    """A column from 0 to 1 for each name: the ``greatest`` of components, or the ``mean`` of weighted ones, 1 at most; NULL counts as 0.

    ``parts`` maps a name to how and to components with their weights.
    """
    made = {}
    for name, (how, components) in parts.items():
        terms = [F.coalesce(F.col(c), F.lit(0.0)) * float(w) for c, w in components.items()]
        one = sum(terms[1:], terms[0]) / len(terms) if how == "mean" else F.greatest(F.lit(0.0), *terms)
        made[name] = F.least(F.lit(1.0), one)
    return rows.withColumns(made)


def weighted_score(rows: DataFrame, weights: Mapping[str, float], name: str) -> DataFrame:
    """``name``: the half-even rounded sum of components times weights."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return rows.withColumn(name, F.bround(total).cast("int"))


def flag_rules(rows: DataFrame, rules: Mapping[str, str], score: str, least: int, label: str) -> DataFrame:
    """A boolean column per rule (an SQL predicate; unknown is false), their number, and whether it reaches ``least``."""
    flagged = rows.withColumns({n: holds(F.expr(p)) for n, p in rules.items()})
    n = sum((F.col(r).cast("int") for r in rules), F.lit(0))
    return flagged.withColumn(score, n).withColumn(label, F.col(score) >= least)


def ordered_phrases(rows: DataFrame, phrases: Sequence[tuple[str, Column]], name: str, separator: str = " ; ") -> DataFrame:
    """``name``: the phrases joined, by their component descending, ties in the given order."""
    items = F.array(*[F.struct((-F.coalesce(F.col(c), F.lit(0.0))).alias("by"), F.lit(i).alias("at"), t.alias("text")) for i, (c, t) in enumerate(phrases)])
    return rows.withColumn(name, F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), separator))
