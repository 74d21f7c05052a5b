"""Rolling totals over trailing periods, kept as a versioned daily state.

The state of an entity on a day is, for every period of P days, the exact sum and
count of the amounts of the P days ending with it. It follows from the day before:

    state[d] = state[d - 1] + arrivals[d] - amounts[d - P]

``advance`` does one day as a join; ``backfill`` does the same recurrence for all
days of a calendar at once, all entities of a block together; ``correct`` recomputes
only the days that late or corrected rows touch, as a higher version.

Defined cases: an entity key that is NULL is an entity of its own; a NULL, NaN or
infinite amount adds nothing to sum or count; a day without amounts has sum 0 and
average NULL; rows without a usable date (missing, implausibly old, or after the last
delivery) count for no day, their entity still comes out; an empty table gives an empty result. Sums are kept in whole units (cents) and
are exact. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.arrow_groups import whole_groups
from tidemill.operators.redelivery import fixed_point
from tidemill.session import materialize

PERIODS = (7, 30)
TASK_ROWS = 100_000  # daily amounts of a task: what comes out is larger by the days of the calendar
FIRST_YEAR = 2020  # older dates are implausible for this system


def usable_day(ts: str, first_year: int = FIRST_YEAR, last: str | None = None) -> Column:
    """The calendar day of ``ts``, NULL if it is missing, implausibly old or after ``last``."""
    usable = F.year(ts) >= first_year
    if last is not None:
        usable = usable & (F.to_date(ts) <= F.lit(last).cast("date"))
    return F.when(usable, F.to_date(ts))


def daily_amounts(rows: DataFrame, entity: Sequence[str], ts: str, amount: str,
                  decimals: int = 2, first_year: int = FIRST_YEAR, last: str | None = None) -> DataFrame:
    """(entity..., day, units, n): exact sum and count of amounts per entity and day.

    ``last``: the latest day that a row can be of, such as that of the last delivery; one mistyped
    date beyond it would stretch the calendar of every entity. ``day`` is NULL for rows without a usable date. Partial aggregation runs before
    the exchange, so a hot entity sends one row per day and split.
    """
    units = fixed_point(amount, decimals)
    return (rows.select(*entity, usable_day(ts, first_year, last).alias("day"), units.alias("units"))
            .groupBy(*entity, "day")
            .agg(F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.count("units").alias("n")))


def _runs(at: np.ndarray, day: np.ndarray, amounts: Sequence[np.ndarray], count: int, days: int,
          periods: Sequence[int]) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """(cells, states): where a state begins to hold, as entity * days + day, and the totals of each period and amount.

    The recurrence changes a state only on days on which an amount arrives or expires; a state
    holds from its cell to the next one. Every entity has one from the first day on.
    """
    arrive = at * days + day
    expire = [(arrive + p)[day + p < days] for p in periods]
    cells = np.unique(np.concatenate([np.arange(count, dtype=np.int64) * days, arrive, *expire]))
    begins = np.searchsorted(cells, np.arange(count, dtype=np.int64) * days)
    of = np.repeat(np.arange(count), np.diff(np.append(begins, len(cells))))
    come, states = np.searchsorted(cells, arrive), []
    for p, gone in zip(periods, expire):
        go, totals = np.searchsorted(cells, gone), []
        for x in amounts:
            change = np.zeros(len(cells), dtype=np.int64)
            np.add.at(change, come, x)
            np.subtract.at(change, go, x[day + p < days])
            state = np.cumsum(change)  # across entities, whose own part remains below: exact, as int64 wraps around
            totals.append(state - (state - change)[begins][of])
        states.append(totals)
    return cells, states


def backfill_runner(entity: Sequence[str], first: int, days: int, periods: Sequence[int], groups: int = 4_000):
    """mapInArrow body: rows sorted by entity -> a row for each state of an entity: from which day on and for how many it holds."""
    names = list(entity)

    def emit(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        count = len(starts)
        at = np.repeat(np.arange(count), np.diff(np.append(starts, t.num_rows)))
        day = t.column("day").cast(pa.int32()).fill_null(-(2**31)).to_numpy().astype(np.int64) - first
        inside = (day >= 0) & (day < days)
        amounts = [t.column(c).to_numpy()[inside] for c in ("units", "n")]
        cells, states = _runs(at[inside], day[inside], amounts, count, days, periods)
        holds = np.diff(np.append(cells, count * days))
        out = [t.column(c).combine_chunks().take(pa.array(starts[cells // days])) for c in names]
        out += [pa.array((cells % days).astype(np.int32)), pa.array(holds.astype(np.int32)), *[pa.array(x) for totals in states for x in totals]]
        return pa.RecordBatch.from_arrays(out, [*names, "__from", "__days", *[f"{x}{p}" for p in periods for x in ("s", "n")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, names, groups):
            if days:
                yield emit(t, starts)

    return run


def backfill(daily: DataFrame, entity: Sequence[str], periods: Sequence[int] = PERIODS,
             decimals: int = 2, first: str | None = None, last: str | None = None) -> DataFrame:
    """(entity..., day, sum_Pd, avg_Pd for each period) for every entity and calendar day.

    The calendar runs from the first to the last day of ``daily`` unless given. Daily
    amounts are co-partitioned and sorted by entity once. Of an entity's days those are
    advanced on which an amount arrives or expires, for a block of entities together; a
    state that holds for several days becomes their rows at the end, so what is computed
    and handed over grows with the amounts and not with the calendar.
    """
    daily = materialize(daily, "daily-amounts")
    low, high, rows = daily.agg(F.min("day"), F.max("day"), F.count(F.lit(1))).first()
    parts = max(daily.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    epoch = np.datetime64("1970-01-01")
    low = np.datetime64(first or low) if first or low else None
    high = np.datetime64(last or high) if last or high else None
    days = int((high - low).astype(int)) + 1 if low is not None else 0
    start = int((low - epoch).astype(int)) if low is not None else 0
    fields = [daily.schema[c] for c in entity]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["__from int", "__days int"]
                       + [f"{x}{p} bigint" for p in periods for x in ("s", "n")])
    states = (daily.repartition(parts, *entity).sortWithinPartitions(*entity)
              .mapInArrow(backfill_runner(entity, start, max(days, 0), periods), schema))
    # Totals are computed once for each state, before it is spread over its days.
    spread = totals(states.withColumn("day", F.date_add(F.lit(str(low) if low is not None else "1970-01-01").cast("date"), F.col("__from"))),
                    entity, periods, decimals, "__days").withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__days") - 1)))
    return spread.withColumn("day", F.date_add("day", F.col("__i"))).drop("__days", "__i")


def state_on(daily: DataFrame, entity: Sequence[str], day: str, periods: Sequence[int] = PERIODS,
             version: int = 0) -> DataFrame:
    """The state of every entity on one day, straight from daily amounts: a first load."""
    aggs = []
    for p in periods:
        inside = F.col("day").between(F.date_sub(F.lit(day).cast("date"), p - 1), F.lit(day).cast("date"))
        aggs += [F.coalesce(F.sum(F.when(inside, F.col("units"))), F.lit(0)).alias(f"s{p}"),
                 F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias(f"n{p}")]
    return daily.groupBy(*entity).agg(*aggs).select(
        *entity, F.lit(day).cast("date").alias("day"), F.lit(version).cast("int").alias("version"),
        *[f"{x}{p}" for p in periods for x in ("s", "n")])


def advance(state: DataFrame, daily: DataFrame, entity: Sequence[str], day: str,
            periods: Sequence[int] = PERIODS, version: int = 0) -> DataFrame:
    """The state on ``day`` from the state of the day before.

    Yesterday's totals are joined (full outer, NULL keys equal) with today's arrivals
    and the amounts of the days that expire. Only those few days of ``daily`` are
    read: the filter on ``day`` reaches the scan, and prunes partitions if the table
    is partitioned by day. Entities seen first today start at 0.
    """
    today = F.lit(day).cast("date")
    moves = [F.when(F.col("day") == today, 1).otherwise(0)]
    moving = daily.filter(F.col("day").isin(today, *[F.date_sub(today, p) for p in periods]))
    aggs = []
    for p in periods:
        sign = moves[0] - F.when(F.col("day") == F.date_sub(today, p), 1).otherwise(0)
        aggs += [F.sum(sign * F.col("units")).alias(f"ds{p}"), F.sum(sign * F.col("n")).alias(f"dn{p}")]
    delta = moving.groupBy(*entity).agg(*aggs)
    old = state.drop("day", "version")
    names = [f"{x}{p}" for p in periods for x in ("s", "n")]
    both = (old.select(*entity, *names).unionByName(
        delta.select(*entity, *[F.col(f"d{c}").alias(c) for c in names])))
    return (both.groupBy(*entity).agg(*[F.sum(c).alias(c) for c in names])
            .select(*entity, today.alias("day"), F.lit(version).cast("int").alias("version"), *names))


def correct(states: DataFrame, deltas: DataFrame, entity: Sequence[str], last: str,
            version: int, periods: Sequence[int] = PERIODS) -> DataFrame:
    """New versions of the states that corrections touch, and of no others.

    ``deltas`` are signed changes of daily amounts (entity..., day, units, n): a row
    taken back has negative units and n. A change on day d touches the days d to
    d + P - 1, up to ``last``. Only the states of those
    entities and days are read. Read the table of all versions with ``current``.
    """
    span = max(periods)
    days = F.sequence(F.col("day"), F.least(F.date_add("day", span - 1), F.lit(last).cast("date")))
    spread = (deltas.filter(F.col("day") <= F.lit(last).cast("date"))
              .select(*entity, F.col("day").alias("__d"), "units", "n", F.explode(days).alias("day")))
    aggs = []
    for p in periods:
        inside = F.datediff("day", "__d") < p
        aggs += [F.coalesce(F.sum(F.when(inside, F.col("units"))), F.lit(0)).alias(f"s{p}"),
                 F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias(f"n{p}")]
    touched = spread.groupBy(*entity, "day").agg(*aggs)
    names = [f"{x}{p}" for p in periods for x in ("s", "n")]
    keys = [*entity, "day"]
    which = touched.select(*[F.col(c).alias(f"__{c}") for c in keys])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])
    before = current(states.join(which, same, "left_semi"), entity).select(*keys, *names, F.lit(0).alias("__t"))
    both = before.unionByName(touched.select(*keys, *names, F.lit(1).alias("__t")))
    return (both.groupBy(*keys).agg(F.max("__t").alias("__t"), *[F.sum(c).alias(c) for c in names])
            .filter("__t = 1").select(*keys, F.lit(version).cast("int").alias("version"), *names))


def current(states: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Of every entity and day the row of the highest version."""
    w = Window.partitionBy(*entity, "day").orderBy(F.desc("version"))
    return states.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def totals(states: DataFrame, entity: Sequence[str], periods: Sequence[int] = PERIODS, decimals: int = 2,
           *keep: str) -> DataFrame:
    """Sums and averages in the amount's unit, of a table of states; ``keep``: further columns."""
    unit = float(10**decimals)
    out = [*entity, "day", *keep]
    for p in periods:
        s = F.col(f"s{p}") / F.lit(unit)
        out += [s.alias(f"sum_{p}d"), F.when(F.col(f"n{p}") > 0, s / F.col(f"n{p}")).alias(f"avg_{p}d")]
    return states.select(*out)
