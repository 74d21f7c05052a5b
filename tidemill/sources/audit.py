"""Profiling of raw delimited lines before any schema is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.profile import TYPE_PATTERNS, TYPES
from tidemill.session import materialize

SAMPLES = 6
MOST_DISTINCT = 5_000
FEW_DISTINCT = 20


_SPLIT = "\uffff"  # no character of any text


def values_of(line: str) -> Column:
    """The values of a line, split at commas outside quotes in one forward pass; wrapping quotes are taken off.

    Between two quotes is every second piece of a line cut at quotes (a doubled quote leaves an empty piece
    outside), so only commas of the other pieces part values. A quote that is never closed reaches to the end.
    """
    pieces = F.transform(F.split(F.col(line), '"', -1), lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit(","), F.lit(_SPLIT))).otherwise(x))
    parts = F.split(F.array_join(pieces, '"'), _SPLIT, -1)
    wrapped = lambda v: v.startswith('"') & v.endswith('"') & (F.length(v) > 1)
    return F.transform(parts, lambda v: F.when(wrapped(v), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v))


def field_counts(lines: DataFrame, line: str) -> DataFrame:
    """(n_fields, n_lines); a NULL line has no fields."""
    return lines.select(F.coalesce(F.size(values_of(line)), F.lit(0)).alias("n_fields")).groupBy("n_fields").agg(F.count(F.lit(1)).alias("n_lines"))


def _type_of(v: Column) -> Column:
    found = F.when(v == "", "EMPTY")
    for name, pattern in TYPE_PATTERNS.items():
        found = found.when(v.rlike(pattern), name)
    return found.otherwise("OTHER")


def position_counts(lines: DataFrame, line: str) -> DataFrame:
    """(position, value, n): how often each value stands at each position, counted before the exchange."""
    return (lines.filter(F.col(line).isNotNull()).select(F.posexplode(values_of(line)).alias("position", "value"))
            .groupBy("position", "value").agg(F.count(F.lit(1)).alias("n")))


def position_profile(counts: DataFrame) -> DataFrame:
    """Per position: seen, filled, counts by type class, distinct values and whether they are many."""
    t = _type_of(F.col("value"))
    filled = F.col("value") != ""
    return (counts.withColumn("__t", t).groupBy("position").agg(
        F.sum("n").alias("n_seen"), F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("n_nonempty"),
        *[F.coalesce(F.sum(F.when(F.col("__t") == x, F.col("n"))), F.lit(0)).alias(f"n_{x.lower()}") for x in TYPES],
        F.count(F.when(filled, 1)).alias("n_distinct"))
        .withColumn("many_distinct", F.col("n_distinct") > MOST_DISTINCT))


def samples(lines: DataFrame, line: str, order: str, k: int = SAMPLES) -> DataFrame:
    """(position, values): the first filled values of each position, by ``order``; a report of k values.

    Each position's first k come from a group limit that runs before the exchange.
    """
    cells = lines.filter(F.col(line).isNotNull()).select(order, F.posexplode(values_of(line)).alias("position", "value")).filter(F.col("value") != "")
    w = Window.partitionBy("position").orderBy(order)
    first = cells.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    return first.groupBy("position").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda x: x["value"]).alias("values"))


def low_cardinality(counts: DataFrame, most: int = FEW_DISTINCT) -> DataFrame:
    """(position, values): the distinct filled values of positions that have few."""
    filled = counts.filter(F.col("value") != "")
    few = filled.groupBy("position").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") <= most).drop("d")
    return filled.join(few, "position").groupBy("position").agg(F.array_sort(F.collect_list("value")).alias("values"))


def binary_candidates(counts: DataFrame) -> DataFrame:
    """Positions whose filled values are all 0 or 1."""
    filled = counts.filter(F.col("value") != "")
    return (filled.groupBy("position").agg(F.count(F.when(~F.col("value").isin("0", "1"), 1)).alias("other"), F.sum(F.when(F.col("value") == "1", F.col("n")).otherwise(0)).alias("n_one"), F.sum("n").alias("n_filled"))
            .filter("other = 0").select("position", "n_one", "n_filled"))


def padded(lines: DataFrame, line: str, names: Sequence[str]) -> DataFrame:
    """Every column of ``lines`` but the line, and a column for each name: short lines are padded with '', long ones cut; a NULL line is all ''."""
    v = F.coalesce(values_of(line), F.array())
    rest = [c for c in lines.columns if c != line]
    return lines.select(*rest, v.alias("__v")).select(*rest, *[F.coalesce(F.get("__v", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def full_audit(lines: DataFrame, line: str, order: str) -> DataFrame:
    """One row per position: the profile, the share of filled values in percent, samples, listed values if few, whether all are 0 or 1."""
    counts = materialize(position_counts(lines, line), "position-counts")
    p = position_profile(counts).withColumn("pct_nonempty", F.round(100.0 * F.col("n_nonempty") / F.col("n_seen"), 4))
    first = samples(lines, line, order).withColumnRenamed("values", "sample_values")
    few = low_cardinality(counts).withColumnRenamed("values", "distinct_values")
    flags = binary_candidates(counts).select("position", F.lit(True).alias("binary"))
    joined = p.join(first, "position", "left").join(few, "position", "left").join(flags, "position", "left")
    return joined.withColumn("binary", F.coalesce("binary", F.lit(False)))


def audit_report(lines: DataFrame, line: str, order: str, source: str) -> dict:
    """The whole audit as one dictionary, to be written as JSON: as many entries as positions and numbers of fields."""
    fields = {r.n_fields: r.n_lines for r in field_counts(lines, line).orderBy("n_fields").collect()}
    rows = [r.asDict() for r in full_audit(lines, line, order).orderBy("position").collect()]
    return {"source": source, "lines": sum(fields.values()), "field_counts": fields, "positions": rows, "binary_candidates": [r["position"] for r in rows if r["binary"]]}
