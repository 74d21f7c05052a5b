"""Pairing records of two tables by entity with the nearest in time.

Both tables are laid out by entity and stretch of time in one exchange, sorted within
partitions, and merged by one pass over each partition that holds only the records
within the tolerance of its position and the last right record before them. Stretches
cut a hot entity into many groups; a right record near the edge of its stretch
is also given to the neighbouring one, so no pair is lost.

Defined cases: a record without entity, time or identifier pairs with nothing; of
equally near right records the earlier one is taken, then the one of the smaller
identifier; a right record may serve any number of left ones; repeated equal left
records come out as often as they came in; an empty table gives an empty result. Only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.arrow_groups import changes

STRETCH_NS = 6 * 3_600 * 10**9


def plain_entity(c: str) -> Column:
    """An entity's name without white space and regardless of case; NULL if nothing is left."""
    bare = F.lower(F.regexp_replace(F.col(c), r"(?U)\s+", ""))
    return F.when(bare != "", bare)


def instant_ns(date_part: str, fraction_ns: str) -> Column:
    """Nanoseconds since 1970 of ``dd/MM/yy HH:mm:ss`` (20yy) plus a fraction; NULL if no real date."""
    shaped = F.when(F.col(date_part).rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"), F.col(date_part))
    seconds = F.unix_micros(F.try_to_timestamp(shaped, F.lit("dd/MM/yy HH:mm:ss")))
    return seconds * 1_000 + F.coalesce(F.col(fraction_ns), F.lit(0))


def _last_where(mask: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Index of the last row at or before each row where ``mask`` holds in its group, else -1."""
    at = np.arange(len(mask))
    last = np.maximum.accumulate(np.where(mask, at, -1))
    begin = np.maximum.accumulate(np.where(new, at, -1))
    return np.where(last >= begin, last, -1)


def _merge(tolerance: int):
    """mapInArrow body: records sorted by (hash, entity, stretch, time, side, id) -> left records with their match."""

    def step(t: pa.Table, ended: bool) -> tuple[pa.RecordBatch, pa.Table]:
        rows = t.num_rows
        new = changes([t.column("entity").combine_chunks()]) | changes([t.column("stretch").combine_chunks()])
        ns = t.column("ns").to_numpy()
        left = t.column("is_left").to_numpy().astype(bool)
        ids = t.column("id").to_numpy()
        right = ~left
        # The first of the right records that share a group and an instant has the smallest identifier.
        same = np.r_[False, right[1:] & right[:-1] & ~new[1:] & (ns[1:] == ns[:-1])]
        first = np.maximum.accumulate(np.where(~same, np.arange(rows), 0))
        before = _last_where(right, new)
        ends = np.r_[new[1:], True]
        after = _last_where(right[::-1], ends[::-1])[::-1]
        after = np.where(after >= 0, rows - 1 - after, -1)
        if ended:
            done = rows
        else:
            group = int(np.flatnonzero(new)[-1])
            done = max(group, int(np.searchsorted(ns[group:], ns[-1] - tolerance)) + group)
        mine = np.flatnonzero(left[:done])
        b, a = before[mine], after[mine]
        far = np.iinfo(np.int64).max
        gap_b = np.where(b >= 0, ns[mine] - ns[b], far)
        gap_a = np.where(a >= 0, ns[a] - ns[mine], far)
        best = np.where(gap_b <= gap_a, first[b], a)
        gap = np.minimum(gap_b, gap_a)
        none = gap > tolerance
        out = pa.RecordBatch.from_arrays(
            [pa.array(ids[mine]), pa.array(ids[best], mask=none), pa.array(np.where(gap_b <= gap_a, -gap, gap), mask=none)],
            ["left_id", "right_id", "gap_ns"])
        rest = t.slice(done)
        if done < rows and (p := before[done - 1] if done and not new[done] else -1) >= 0:
            p = int(first[p])
            rest = pa.concat_tables([t.slice(p, 1), rest])
        return out, rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            out, held = step(held, False)
            held = held.combine_chunks()
            yield out
        if held is not None and held.num_rows:
            yield step(held, True)[0]

    return run


def nearest(left: DataFrame, right: DataFrame, tolerance_ns: int, stretch_ns: int = STRETCH_NS) -> DataFrame:
    """(left_id, right_id, gap_ns): every left record with the nearest right one of its entity.

    Both tables have (entity string, ns bigint, id bigint). ``gap_ns`` is signed,
    negative if the right record is earlier; right_id and gap_ns are NULL where nothing is
    within ``tolerance_ns`` (inclusive). Rows without entity, time or id are left out.
    """
    if stretch_ns < tolerance_ns:
        raise ValueError("a stretch of time must not be shorter than the tolerance")
    usable = F.col("entity").isNotNull() & F.col("ns").isNotNull() & F.col("id").isNotNull()

    def at(c: Column) -> Column:
        return (c - F.pmod(c, F.lit(stretch_ns))) / F.lit(stretch_ns)

    lefts = left.filter(usable).select("entity", "ns", "id", F.lit(1).cast("tinyint").alias("is_left"),
                                       at(F.col("ns")).cast("bigint").alias("stretch"))
    places = F.array_distinct(F.array(*[at(F.col("ns") + d).cast("bigint") for d in (-tolerance_ns, 0, tolerance_ns)]))
    rights = right.filter(usable).select("entity", "ns", "id", F.lit(0).cast("tinyint").alias("is_left"),
                                         F.explode(places).alias("stretch"))
    both = lefts.unionByName(rights).withColumn("h", F.xxhash64("entity", "stretch"))
    laid = both.repartition("h").sortWithinPartitions("h", "entity", "stretch", "ns", "is_left", "id")
    return (laid.select("entity", "stretch", "ns", "is_left", "id")
            .mapInArrow(_merge(tolerance_ns), "left_id bigint, right_id bigint, gap_ns bigint"))
