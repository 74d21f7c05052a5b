"""Typing, quarantine, duplicate flags and checks of delivered rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.exprs import holds, key, merge_fraction, micros, number, whole_number


def cast_types(raw: DataFrame, dates: Mapping[str, tuple[str, str]], numbers: Sequence[str], whole: Sequence[str]) -> DataFrame:
    """Merge date and fraction columns, cast numbers; what does not fit is NULL. The raw date parts go, fractions stay."""
    out = raw.withColumns({name: merge_fraction(d, f) for name, (d, f) in dates.items()})
    out = out.withColumns({c: number(c) for c in numbers} | {c: whole_number(c) for c in whole})
    return out.drop(*[d for d, _ in dates.values()])


def quarantine(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, the rest): a row whose validity is unknown is in quarantine."""
    return rows.filter(holds(valid)), rows.filter(~holds(valid))


def usable_date(ts: str, first_year: int = 2020) -> Column:
    return F.year(ts) >= first_year


def bounded(amount: str, most: float = 10_000_000) -> Column:
    return F.col(amount) <= most


def drop_technical_duplicates(rows: DataFrame, code: str, order: Sequence[str]) -> DataFrame:
    """The first row of every code, by ``order``; rows without a code are one group each by content."""
    spread = F.when(F.col(code).isNull(), F.xxhash64(*rows.columns))
    w = Window.partitionBy(code, spread).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def flag_functional_duplicates(rows: DataFrame, same: Sequence[str], ts: str, tie: str, minutes: float, name: str) -> DataFrame:
    """``name``: the row follows one of the same values within so many minutes.

    A row is looked for in its own and the last stretch of time, so a hot group of same
    values is spread over time. NULL and '' are values like others.
    """
    width = int(minutes * 60_000_000)
    stretch = 64 * width
    us = micros(ts)
    keys = [f"__k{i}" for i in range(len(same))]
    keyed = rows.withColumns({k: key(c) for k, c in zip(keys, same)}).withColumn("__us", us).withColumn("__s", F.floor(F.col("__us") / stretch))
    light = keyed.filter(F.col("__us") - F.col("__s") * stretch >= stretch - width).groupBy(*keys, (F.col("__s") + 1).alias("__s")).agg(F.max("__us").alias("__before"))
    w = Window.partitionBy(*keys, "__s").orderBy("__us", tie)
    marked = keyed.withColumn("__lag", F.lag("__us").over(w)).join(light, [*keys, "__s"], "left")
    return marked.withColumn(name, holds(F.col("__us") - F.coalesce("__lag", "__before") <= width)).select(*rows.columns, name)


def normalize_categoricals(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.withColumns({c: F.upper(F.trim(c)) for c in columns})


def present(c: str) -> Column:
    """Whether a text is there: not NULL and not blank."""
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


def clean_transactions(rows: DataFrame, code: str, order: Sequence[str], categories: Sequence[str], status: str, valid: str, partner: str,
                       same: Sequence[str], ts: str, minutes: float) -> DataFrame:
    """First row of each code, plain categories, ``is_valid``, ``has_partner`` and ``is_duplicate``, in this order."""
    out = normalize_categoricals(drop_technical_duplicates(rows, code, order), categories)
    out = out.withColumn("is_valid", holds(F.col(status) == valid)).withColumn("has_partner", present(partner))
    return flag_functional_duplicates(out, same, ts, code, minutes, "is_duplicate")


def offending(rows: DataFrame, code: str, fails: Column, most: int = 200) -> DataFrame:
    """The codes of rows that fail, the first ``most`` in order: a report."""
    return rows.filter(holds(fails)).select(code).distinct().orderBy(F.col(code).asc_nulls_last()).limit(most)


def unknown(rows: DataFrame, category: str, allowed: DataFrame) -> DataFrame:
    """The categories of rows that are none of the allowed ones, sorted."""
    return rows.filter(F.col(category).isNotNull()).select(category).distinct().join(allowed.select(category).distinct(), category, "left_anti").orderBy(category)


def checks(rows: DataFrame, code: str, amount: str, most: float, category: str, allowed: DataFrame, critical: Sequence[str]) -> DataFrame:
    """One row per check: name, failures, passed. One pass over the rows and one over their categories."""
    one = rows.agg(
        (F.count(F.lit(1)) - F.count_distinct(code) - F.max(F.when(F.col(code).isNull(), 1).otherwise(0))).alias("unique_code"),
        F.count(F.when(F.col(amount) > most, 1)).alias("bounded_amount"),
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"filled_{c}") for c in critical])
    names = ["unique_code", "bounded_amount", *[f"filled_{c}" for c in critical]]
    stacked = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).cast("bigint").alias("failures")) for n in names])).alias("x")).select("x.*")
    known = allowed.select(F.col(category).alias("__c")).distinct()
    seen = rows.filter(F.col(category).isNotNull()).select(F.col(category).alias("__c")).distinct()
    unknown = seen.join(known, "__c", "left_anti").agg(F.count(F.lit(1)).alias("failures")).select(F.lit("known_category").alias("check_name"), "failures")
    both = stacked.unionByName(unknown)
    return both.withColumn("passed", F.col("failures") == 0)
