"""Column expressions with the semantics the reference's numbers rest on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_KEY = "\x00null"


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def key(c: str) -> Column:
    """A key that is never NULL, so that NULL keys group and join as one key."""
    return F.coalesce(F.col(c).cast("string"), F.lit(NO_KEY))


def pdiv(n: Column, d: Column) -> Column:
    """Division where x/0 is plus or minus infinity and 0/0 is NULL."""
    inf = F.lit(float("inf"))
    return F.when(d == 0, F.when(n > 0, inf).when(n < 0, -inf)).otherwise(n / d)


def null_if_zero(c: Column) -> Column:
    return F.when(c != 0, c)


def holds(predicate: Column) -> Column:
    """A predicate where unknown is false."""
    return F.coalesce(predicate, F.lit(False))


def within(c: Column, low: float, high: float) -> Column:
    """Inclusive range predicate; NULL is outside."""
    return holds(c.between(low, high))


def number(c: str) -> Column:
    """A text as a number, written plainly or with an exponent, or infinity; NULL if it is none (the suffixes that a cast would take included)."""
    plain = F.col(c).rlike(r"^\s*[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?\s*\z|(?i)^\s*[+-]?inf(?:inity)?\s*\z")
    return F.when(plain, F.expr(f"try_cast(`{c}` AS double)"))


def whole_number(c: str) -> Column:
    """A text as a whole number, an exponent allowed; NULL if it is none or too large."""
    x = number(c)
    return F.coalesce(F.expr(f"try_cast(`{c}` AS bigint)"), F.when((F.abs(x) <= 9e15) & (x == F.floor(x)), x.cast("bigint")))


def merge_fraction(date_part: str, fraction_ns: str) -> Column:
    """``dd/MM/yy HH:mm:ss`` plus nanoseconds as a timestamp without zone; the year 69 and up is of 1900.

    What is no real date gives NULL, a bad or missing fraction counts as 0; microseconds
    are kept, so carry the fraction along where nanoseconds matter.
    """
    shaped = F.when(F.col(date_part).rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"), F.col(date_part))
    base = F.try_to_timestamp(shaped, F.lit("dd/MM/yy HH:mm:ss"))
    base = F.when(F.year(base) >= 2069, F.add_months(base, -1200).cast("timestamp") + (base - F.date_trunc("day", base))).otherwise(base)
    fraction = F.coalesce(F.expr(f"try_cast(`{fraction_ns}` AS bigint)"), F.when(F.abs(number(fraction_ns)) < 1e18, F.floor(number(fraction_ns)).cast("bigint")), F.lit(0))
    return F.timestamp_micros(F.unix_micros(base) + F.floor(fraction / 1000).cast("bigint")).cast("timestamp_ntz")


def level(rate: Column, bounds: Sequence[float]) -> Column:
    """How many of the ascending bounds a rate reaches (left-closed); NULL counts as 0."""
    return sum((F.when(F.coalesce(rate, F.lit(0.0)) >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def label(rank: Column, names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), rank + 1)


def interval_label(score: Column, intervals: Mapping[str, tuple[int, int]], default: str) -> Column:
    """The name of the inclusive interval that holds the score."""
    found = None
    for name, (low, high) in intervals.items():
        found = (F.when if found is None else found.when)(score.between(low, high), name)
    return F.lit(default) if found is None else found.otherwise(default)


def rounded_text(c: Column) -> Column:
    """A number as text without decimals, thousands parted by commas, ties to even; NULL stays NULL."""
    return F.format_number(F.bround(c), 0)


def percent_text(c: Column) -> Column:
    """A share as text in whole percent, ties to even."""
    return F.concat(rounded_text(c * 100), F.lit(" %"))
