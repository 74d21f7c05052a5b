"""What came before each row: running, expanding and trailing values per key.

The rows of a key are cut by day (or by stretches of time), so a key that holds a
third of the table is many groups; what earlier days add is carried by a small table
of totals per key and day. Ties of time are ordered by a second column, which
should be unique within them. NULL keys are one key. A row without a time comes out
with values of nothing (sums 0, others NULL) and counts for no other row.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.exprs import key, micros
from tidemill.operators.arrow_groups import changes, whole_groups
from tidemill.session import materialize

DAY_US = 86_400_000_000
_NO_DAY = -(1 << 40)


@dataclass(frozen=True)
class Carried:
    """A value carried along: ``sum``, ``max`` or ``min`` of a column."""

    of: Column
    how: str = "sum"

    def over(self, c: Column) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.how](c)

    def join(self, a: Column, b: Column) -> Column:
        if self.how == "sum":
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        return (F.greatest if self.how == "max" else F.least)(a, b)


def stretch_of(rows: DataFrame, ts: str, most_rows: int = 2_000_000, share: float = 1 / 3) -> int:
    """Microseconds of a stretch of which a key holding ``share`` of all rows has about ``most_rows`` at most: a day, or a day halved some times.

    One aggregated row says it; time is taken as evenly used.
    """
    n, low, high = rows.agg(F.count(F.lit(1)), F.min(micros(ts)), F.max(micros(ts))).first()
    stretch = DAY_US
    while low is not None and n * share * min(1.0, stretch / max(1, high - low)) > most_rows and stretch > 1_000_000:
        stretch //= 2
    return stretch


def before(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, values: Mapping[str, Carried],
           strictly_earlier: bool = False, including: bool = False, base: DataFrame | None = None, stretch_us: int = DAY_US) -> DataFrame:
    """The rows with each value over the rows of the same keys that came before.

    Before means an earlier (time, tie); with ``strictly_earlier`` an earlier time, ties
    excluded; with ``including`` the row itself counts too. Sums of nothing are 0. ``base``
    gives the totals of days if they come cheaper from it than from ``rows``: a table of the
    same rows without what was added to them. ``stretch_us``: a key's rows are cut into stretches
    of so much time, of which one task orders the rows; see ``stretch_of``.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    names = list(values)
    us = micros(ts)

    def key_rows(df: DataFrame) -> DataFrame:
        keyed = df.withColumns({k: key(c) for k, c in zip(ks, keys)} | {"__us": us} | {f"__v_{n}": F.when(us.isNotNull(), v.of) for n, v in values.items()})
        return keyed.withColumn("__day", F.coalesce(F.floor(F.col("__us") / stretch_us), F.lit(_NO_DAY)))

    keyed = key_rows(rows)
    inside = Window.partitionBy(*ks, "__day")
    if strictly_earlier:
        inside = inside.orderBy("__us").rangeBetween(Window.unboundedPreceding, -1)
    else:
        inside = inside.orderBy("__us", tie).rowsBetween(Window.unboundedPreceding, 0 if including else -1)
    own = keyed.withColumns({f"__i_{n}": v.over(F.col(f"__v_{n}")).over(inside) for n, v in values.items()})
    totals = key_rows(rows if base is None else base).groupBy(*ks, "__day").agg(*[v.over(F.col(f"__v_{n}")).alias(f"__t_{n}") for n, v in values.items()])
    days = Window.partitionBy(*ks).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(*ks, "__day", *[v.over(F.col(f"__t_{n}")).over(days).alias(f"__e_{n}") for n, v in values.items()])
    joined = own.join(earlier, [*ks, "__day"])
    return joined.select(*[F.col(c) for c in rows.columns], *[values[n].join(F.col(f"__e_{n}"), F.col(f"__i_{n}")).alias(n) for n in names])


def first_occurrence(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, name: str, counts: Column | None = None,
                     base: DataFrame | None = None) -> DataFrame:
    """``name``: no row of the same keys came before; False for a row without a time.

    The first row is found by aggregation, not in a window; ``base`` as in ``before``.
    """
    ks = [f"__k{i}" for i in range(len(keys))]

    def key_rows(df: DataFrame) -> DataFrame:
        return df.withColumns({k: key(c) for k, c in zip(ks, keys)} | {"__at": F.when(
            F.col(ts).isNotNull(), F.struct(micros(ts).alias("us"), F.col(tie).alias("tie")))})

    keyed = key_rows(rows)
    first = key_rows(rows if base is None else base).groupBy(*ks).agg(F.min("__at").alias("__first"))
    is_first = F.coalesce(F.col("__at") == F.col("__first"), F.lit(False))
    if counts is not None:
        is_first = is_first & counts
    return keyed.join(first, ks).withColumn(name, is_first).select(*rows.columns, name)


def trailing(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, units: Column, windows: Mapping[str, int], stretch_us: int = DAY_US) -> DataFrame:
    """``n_<w>`` and ``units_<w>`` over (t - w, t] for each window, later ties of t excluded.

    ``windows`` maps names to microseconds. A row arrives at t and leaves a window at t + w:
    the state of a window at a row is what has arrived less what has left, running sums
    over one stream of events, split by day like all history. So a window's width costs
    nothing, each row gets its states where it arrives, and only slim events of departure are exchanged
    besides the rows. ``units`` are whole numbers; a row without a time has 0.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    keyed = rows.select(F.struct(*rows.columns).alias("__row"), *[key(c).alias(k) for k, c in zip(ks, keys)], micros(ts).alias("__us"),
                        F.coalesce(units, F.lit(0)).cast("bigint").alias("__u"), F.col(tie).alias("__tie"))
    none = F.lit(None)
    here = F.struct(F.lit(1).alias("at"), F.col("__tie").alias("tie"))
    arrive = keyed.select(*ks, "__us", "__u", F.lit("").alias("__w"), here.alias("__o"), "__row")
    leave = keyed.filter("__us is not null").select(*ks, "__us", "__u", F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(us).alias("us")) for w, us in windows.items()])).alias("__e"))
    leave = leave.select(*ks, (F.col("__us") + F.col("__e.us")).alias("__us"), "__u", F.col("__e.w").alias("__w"),
                         F.struct(F.lit(0).alias("at"), none.cast(rows.schema[tie].dataType).alias("tie")).alias("__o"))
    slim = arrive.drop("__row").unionByName(leave)
    events = arrive.unionByName(leave, allowMissingColumns=True)
    values = {}
    for w in windows:
        sign = F.when(F.col("__w") == "", 1).when(F.col("__w") == w, -1).otherwise(0)
        values |= {f"n_{w}": Carried(sign), f"units_{w}": Carried(sign * F.col("__u"))}
    got = before(events.withColumn("__at", F.timestamp_micros("__us")), ks, "__at", "__o", values, including=True, base=slim.withColumn("__at", F.timestamp_micros("__us")), stretch_us=stretch_us)
    return got.filter("__w = ''").select("__row.*", *values)


STRETCH_ROWS = 20_000  # rows of a key that one pass holds, besides as many earlier values on either side of their median


def _windows(ks: Sequence[str]):
    """mapInArrow body: (keys, stretch, bin, n) sorted -> for each later stretch what part of the earlier values it can need.

    A stretch of r values moves a median by r ranks at most. Of the m earlier values it needs those of
    the ranks ``lo`` to ``hi``, which lie in the bins ``from`` to ``to``; ``below`` are in lesser bins. Held
    are the counts of one key's bins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bins, counts = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t, starts in whole_groups(batches, [*ks, "__s"], 256):
            out = []
            at, n = t.column("__bin").to_numpy(), t.column("__n").to_numpy()
            heads = t.select([*ks, "__s"]).take(pa.array(starts)).to_pylist()
            for i, (begin, end) in enumerate(zip(starts, [*starts[1:], t.num_rows])):
                who = tuple(heads[i][k] for k in ks)
                if who != last:
                    last, bins, counts = who, np.zeros(0, np.int64), np.zeros(0, np.int64)
                m, r = int(counts.sum()), int(n[begin:end].sum())
                if m:
                    lo, hi = max(0, (m - 1) // 2 - r), min(m - 1, (m + r) // 2)
                    upto = np.cumsum(counts)
                    first, end_bin = np.searchsorted(upto, [lo, hi], side="right")
                    out.append((*who, heads[i]["__s"], int(bins[first]), int(bins[end_bin]), int(upto[first] - counts[first]), m, lo, hi))
                bins, inverse = np.unique(np.concatenate([bins, at[begin:end]]), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate([counts, n[begin:end]]), minlength=len(bins)).astype(np.int64)
            cols = [*zip(*out)] if out else [[] for _ in range(len(ks) + 7)]
            types = [*[pa.string()] * len(ks), *[pa.int64()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], [*ks, "__s", "__from", "__to", "__below", "__m", "__lo", "__hi"])

    return run


def _medians(ks: Sequence[str], kept: Sequence[str], value: str, name: str):
    """mapInArrow body: a stretch's earlier values, then its rows -> the rows with the median of all earlier values.

    Earlier values come as (value, ``__n`` times) with the ranks that are needed, and are cut to those. Held is one sorted
    list of a stretch. A value put in beyond an end of the list lies wrong only among ranks that no median of the stretch reaches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, below, total, passed = None, [], 0, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = changes([b.column(k) for k in [*ks, "__s"]])
            head = tuple(b.column(k)[0].as_py() for k in [*ks, "__s"])
            new[0] = head != last
            last = tuple(b.column(k)[b.num_rows - 1].as_py() for k in [*ks, "__s"])
            values = b.column("__v").to_pylist()
            times, m, lo, hi, under = (b.column(c).to_pylist() for c in ("__n", "__m", "__lo", "__hi", "__below"))
            out: list[float | None] = []
            for i, v in enumerate(values):
                if new[i]:
                    seen, below, total, passed = [], 0, 0, -1
                if times[i] is not None:  # an earlier value
                    if passed < 0:
                        below, total, passed = lo[i], m[i], under[i]
                    n = min(passed + times[i], hi[i] + 1) - max(passed, lo[i])
                    passed += times[i]
                    if n > 0:
                        seen.extend([v] * n)
                    continue
                if total:
                    x, y = (total - 1) // 2 - below, total // 2 - below
                    out.append(seen[x] if x == y else (seen[x] + seen[y]) / 2)
                else:
                    out.append(None)
                if v is not None:
                    bisect.insort(seen, v)
                    total += 1
            rows = b.filter(pc.is_null(b.column("__n")))
            yield pa.RecordBatch.from_arrays([*[rows.column("__row").field(c) for c in kept], pa.array(out, pa.float64())], [*kept, name])

    return run


def prior_median(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, name: str, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """The exact median of a key's earlier values; NaN counts as none.

    A key's rows are cut into stretches of ``stretch_rows`` values. While a stretch passes, the
    median moves by few ranks, so of all earlier values it needs those around their median only,
    which are found by counts per bin of the value and brought to the stretch: no task holds a key's rows.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    v = F.col(value).cast("double")
    there = F.when(micros(ts).isNotNull() & ~F.isnan(v), v)
    counted = before(rows.withColumn("__v", there), keys, ts, tie, {"__c": Carried(F.when(F.col("__v").isNotNull(), 1).otherwise(0))})
    staged = materialize(counted.select(F.struct(*rows.columns).alias("__row"), *[key(c).alias(k) for k, c in zip(ks, keys)], micros(ts).alias("__us"), F.col(tie).alias("__tie"), "__v",
                                        F.floor(F.col("__c") / stretch_rows).cast("bigint").alias("__s")), "stretches")
    place = [*ks, "__s"]
    types = ", ".join(f"{k} string" for k in ks)
    # Keys of several stretches: counts of their values, and of bins that order as the values do.
    long = staged.filter("__s > 0").select(*ks).distinct()
    per = staged.filter("__v is not null").join(long, ks, "left_semi").groupBy(*place, "__v").agg(F.count(F.lit(1)).alias("__n"))
    per = materialize(per.withColumn("__bin", (F.signum("__v") * F.floor(F.log2(1 + F.abs("__v")) * 256)).cast("bigint")), "values")
    bins = per.groupBy(*place, "__bin").agg(F.sum("__n").alias("__n"))
    windows = (bins.repartition(*ks).sortWithinPartitions(*place)
               .mapInArrow(_windows(ks), f"{types}, __s bigint, __from bigint, __to bigint, __below bigint, __m bigint, __lo bigint, __hi bigint"))
    wanted = windows.withColumn("__bin", F.explode(F.sequence("__from", "__to"))).withColumnRenamed("__s", "__at")
    needed = (per.join(wanted, [*ks, "__bin"]).filter(F.col("__s") < F.col("__at"))
              .groupBy(*ks, F.col("__at").alias("__s"), "__v", "__below", "__m", "__lo", "__hi").agg(F.sum("__n").alias("__n")))
    whole = staged.unionByName(needed, allowMissingColumns=True)
    laid = whole.repartition(*place).sortWithinPartitions(*place, F.col("__n").isNull(), F.when(F.col("__n").isNotNull(), F.col("__v")), "__us", "__tie")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return laid.mapInArrow(_medians(ks, rows.columns, value, name), f"{kinds}, `{name}` double")


def asof_backward(left: DataFrame, right: DataFrame, by: tuple[str, str], ts: tuple[str, str], tie: tuple[str, str],
                  take: Sequence[str], left_base: DataFrame | None = None, stretch_us: int = DAY_US) -> DataFrame:
    """The left rows with ``take`` of the last right row strictly earlier, NULL if there is none.

    ``by``, ``ts`` and ``tie`` name the left and the right column. Both sides are one
    stream of events per key, over which the latest right row is carried. ``left_base``: a
    table with the keys and times of the left rows, if those took work to make.
    """
    found = F.struct(micros("__ts").alias("us"), F.col("__tie").alias("tie"), *take)
    empty = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take]
    key_of = [F.col(by[0]).alias("__by"), F.col(ts[0]).alias("__ts"), F.col(tie[0]).alias("__tie")]
    l = left.select(*key_of, *empty, F.struct(*left.columns).alias("__row"), F.lit(True).alias("__left"))
    none = F.lit(None).cast(l.schema["__row"].dataType).alias("__row")
    r = right.filter(F.col(ts[1]).isNotNull()).select(
        F.col(by[1]).alias("__by"), F.col(ts[1]).alias("__ts"), F.col(tie[1]).alias("__tie"), *take, none, F.lit(False).alias("__left"))
    base = None
    if left_base is not None:
        base = left_base.select(*key_of, *empty, F.lit(True).alias("__left")).unionByName(r.drop("__row"))
    got = before(l.unionByName(r), ["__by"], "__ts", "__tie", {"__got": Carried(F.when(~F.col("__left"), found), "max")}, strictly_earlier=True, base=base, stretch_us=stretch_us)
    return got.filter("__left").select("__row.*", *[F.col(f"__got.{c}").alias(c) for c in take])


def asof_forward(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, within_us: int, take: Mapping[str, str]) -> DataFrame:
    """The rows with ``take`` (result name -> column) of the next row of the same keys, strictly later, at most so much later.

    Groups must be small (bounded by the caller).
    """
    w = Window.partitionBy(*keys).orderBy("__us").rangeBetween(1, within_us)
    found = F.min(F.struct(F.col("__us"), F.col(tie).alias("__tie"), *[F.col(c).alias(n) for n, c in take.items()])).over(w)
    return rows.withColumn("__us", micros(ts)).withColumn("__f", found).select(*rows.columns, *[F.col(f"__f.{n}").alias(n) for n in take])
