"""Column-level data quality profiles from maintained value-count tables.

A table of value counts is kept for every load and column. Each delivery is a signed
delta: of every column, its values and how often the load has them (negative when a
load is taken back). Deltas are counted per input split before anything is exchanged and
applied to the kept table by ``maintain``; every metric (filled share, type counts,
distinct values, range and median of numbers, entropy, distance to an accepted profile)
is derived from kept counts alone, exactly, of a load or of all loads together.

Defined cases: NULL and '' are EMPTY; without non-empty values all shares but the
filled one are NULL; a NULL group (load) is a group of its own; repeated rows count as
delivered; an empty table gives an empty result; columns beside the profiled ones are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.arrow_groups import whole_groups
from tidemill.operators.ranged import group_quantiles
from tidemill.session import materialize

# The audit's type classes, the first that fits the whole value holds.
TYPE_PATTERNS = {
    "DATE": r"^\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}\z",
    "TEL": r"^TEL\d+\z",
    "SERVICE": r"^SERVICE_\d+\z",
    "INT": r"^\d+\z",
    "FLOAT": r"^\d+\.\d+\z",
}
TYPES = (*TYPE_PATTERNS, "OTHER")
CHUNK_ROWS = 120_000  # rows of a split counted at a time
BIG_GROUP = 1_000_000  # a group of more rows is cut by value, a part for each so many rows
CELLS_PER_PART = 200_000  # values of a column, over all loads, that a part of it holds, about


def _delta_counter(group: str, columns: Sequence[str], sign: int, parts: Mapping[int | None, int], sub: int):
    """mapInArrow body: rows -> (group, column, parts, part, values, counts), one for each in a chunk."""

    def count(t: pa.Table) -> Iterator[pa.RecordBatch]:
        enc = pa.chunked_array(t.column(group).chunks).combine_chunks().dictionary_encode()
        groups = enc.dictionary
        none = len(groups)
        gcode = enc.indices.fill_null(none).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pa.concat_arrays([groups, pa.nulls(1, groups.type)])
        part_count = np.array([parts.get(x, 1) for x in ids.to_pylist()], dtype=np.int64)
        out: list[list] = [[], [], [], [], [], []]
        for name in columns:
            col = t.column(name).combine_chunks()
            enc = (col if pa.types.is_string(col.type) else col.cast(pa.string())).fill_null("").dictionary_encode()
            size = len(enc.dictionary)
            cell, n = np.unique(gcode * size + enc.indices.to_numpy(), return_counts=True)
            g, code = cell // size, cell % size
            part = np.zeros(len(cell), dtype=np.int64)
            if part_count.max() > 1:
                part = (_hashed(enc.dictionary)[code] % part_count[g].astype(np.uint64)).astype(np.int64)
                order = np.lexsort((part, g))
                g, code, n, part = g[order], code[order], n[order], part[order]
            starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (part[1:] != part[:-1])])
            offsets = pa.array(np.append(starts, len(g)).astype(np.int32))
            out[0].append(ids.take(pa.array(g[starts])))
            out[1].append(pa.array([name] * len(starts)))
            out[2].append(pa.array(part_count[g[starts]]))
            out[3].append(pa.array(part[starts]))
            out[4].append(pa.ListArray.from_arrays(offsets, enc.dictionary.take(pa.array(code))))
            out[5].append(pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64) * sign)))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in out], [group, "column_name", *_CELLS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= sub:
                yield from count(pa.Table.from_batches(held))
                held = []
        if held:
            yield from count(pa.Table.from_batches(held))

    return run


_CELLS = ("parts", "part", "vals", "counts")
_CELL_TYPES = "parts bigint, part bigint, vals array<string>, counts array<bigint>"


def _hashed(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def _flat(t: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row of each value, values, counts) of a table of nested counts."""
    vals = t.column("vals").combine_chunks()
    counts = t.column("counts").combine_chunks()
    row = np.repeat(np.arange(t.num_rows), pc.list_value_length(vals).to_numpy(zero_copy_only=False))
    return row, vals.flatten(), counts.flatten().to_numpy()


def _merger(keys: Sequence[str], groups: int = 400):
    """mapInArrow body: nested counts sorted by keys -> one row of counts per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, keys, groups):
            count = len(starts)
            row, vals, counts = _flat(t)
            if count == t.num_rows and (counts != 0).all():
                yield from t.combine_chunks().to_batches()
                continue
            at = np.repeat(np.arange(count), np.diff(np.append(starts, t.num_rows)))[row]
            enc = vals.dictionary_encode()
            size = max(1, len(enc.dictionary))
            cell, inverse = np.unique(at * size + enc.indices.to_numpy(), return_inverse=True)
            n = np.zeros(len(cell), dtype=np.int64)
            np.add.at(n, inverse, counts)
            cell, n = cell[n != 0], n[n != 0]
            offsets = pa.array(np.searchsorted(cell // size, np.arange(count + 1)).astype(np.int32))
            firsts = pa.array(starts)
            yield pa.RecordBatch.from_arrays(
                [*[t.column(k).combine_chunks().take(firsts) for k in keys],
                 pa.ListArray.from_arrays(offsets, enc.dictionary.take(pa.array(cell % size))),
                 pa.ListArray.from_arrays(offsets, pa.array(n))], [*keys, "vals", "counts"])

    return run


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def load_deltas(rows: DataFrame, group: str, columns: Sequence[str], sign: int = 1, kept: DataFrame | None = None,
                big_group: int = BIG_GROUP, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(group, column_name, parts, part, vals, counts): what each load adds to the kept table, counted split by split.

    An exchange carries each value of a load once per split. A load of more than ``big_group`` rows is cut into parts by a hash
    of the value, so no task gets a whole big load; a load that ``kept`` has keeps its parts there. Only the ids of such loads come
    to the driver, at most one for every ``big_group`` rows.
    """
    sizes = rows.groupBy(group).count().filter(F.col("count") > big_group).collect()
    parts = {r[0]: -(-r[1] // big_group) for r in sizes}
    if kept is not None:
        cut = {r[0]: r[1] for r in kept.filter("parts > 1").select(group, "parts").distinct().collect()}
        parts = {g: n for g, n in parts.items() if kept.filter(F.col(group).eqNullSafe(F.lit(g))).isEmpty()} | cut
    schema = f"`{group}` {_kind(rows, group)}, column_name string, {_CELL_TYPES}"
    return rows.select(group, *columns).mapInArrow(_delta_counter(group, columns, sign, parts, chunk_rows), schema)


def merge_counts(partial: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum nested counts by ``keys``; values whose counts cancel out are gone."""
    laid = partial.select(*keys, "vals", "counts").repartition(*keys).sortWithinPartitions(*keys)
    schema = ", ".join([f"`{k}` {_kind(partial, k)}" for k in keys]) + ", vals array<string>, counts array<bigint>"
    return laid.mapInArrow(_merger(keys), schema)


def maintain(kept: DataFrame | None, deltas: DataFrame, group: str) -> DataFrame:
    """The kept value counts of loads and columns after ``deltas``, written as a table.

    (group, column_name, parts, part, vals, counts). Pass the result with the next deltas;
    taking a load back is applying its negative deltas, after which nothing of it is left.
    Only what is kept of the deltas' loads is merged with them; the rest is passed on as it is, without an exchange.
    """
    keys = [group, "column_name", "parts", "part"]
    if kept is None:
        return materialize(merge_counts(deltas, keys).filter(F.size("vals") > 0), "value-counts")
    deltas = materialize(deltas, "deltas")
    touched = deltas.select(F.col(group).alias("__g")).distinct()
    same = F.col(group).eqNullSafe(F.col("__g"))
    before = kept.select(*deltas.columns)
    merged = merge_counts(before.join(touched, same, "left_semi").unionByName(deltas), keys).filter(F.size("vals") > 0)
    return materialize(before.join(touched, same, "left_anti").unionByName(merged), "value-counts")


def _cutter(parts: int):
    """mapInArrow body: kept counts -> the same of columns, in parts by a hash of the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row, vals, n = _flat(pa.Table.from_batches([b]))
            enc = vals.dictionary_encode()
            part = (_hashed(enc.dictionary) % np.uint64(parts)).astype(np.int64)[enc.indices.to_numpy()] if len(vals) else np.zeros(0, np.int64)
            cell = row * parts + part
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.r_[len(order) > 0, np.diff(cell[order]) != 0]) if len(order) else np.zeros(0, np.int64)
            offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
            at = cell[order][starts] if len(order) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("column_name").take(pa.array(at // parts)), pa.array(np.full(len(at), parts)), pa.array(at % parts),
                 pa.ListArray.from_arrays(offsets, vals.take(pa.array(order))),
                 pa.ListArray.from_arrays(offsets, pa.array(n[order]))], ["column_name", *_CELLS])

    return run


def over_all_loads(kept: DataFrame) -> DataFrame:
    """(column_name, parts, part, vals, counts): the kept counts of every column, summed over the loads."""
    most = kept.groupBy("column_name").agg(F.sum(F.size("vals")).alias("n")).agg(F.max("n")).first()[0]
    parts = max(1, -(-(most or 0) // CELLS_PER_PART))
    cut = kept.select("column_name", "vals", "counts").mapInArrow(_cutter(parts), f"column_name string, {_CELL_TYPES}")
    return materialize(merge_counts(cut, ["column_name", "parts", "part"]).filter(F.size("vals") > 0), "column-counts")


def _classes(vals: pa.Array) -> np.ndarray:
    """The type class of each value, -1 for EMPTY."""
    out = np.full(len(vals), len(TYPES) - 1, dtype=np.int64)
    for i, pattern in reversed([*enumerate(TYPE_PATTERNS.values())]):
        out[pc.match_substring_regex(vals, pattern).to_numpy(zero_copy_only=False)] = i
    out[pc.equal(vals, "").to_numpy(zero_copy_only=False)] = -1
    return out


def _numbers(b: pa.RecordBatch, ranges: Mapping[str, tuple[float, float]]):
    """(row, number, count, whether beyond the accepted range) of the plain numbers of columns that have a range."""
    row, vals, n = _flat(pa.Table.from_batches([b]))
    names = b.column("column_name").to_pylist()
    at = np.flatnonzero(np.isin(row, [i for i, c in enumerate(names) if c in ranges]))
    if len(at):
        kind = _classes(vals.take(pa.array(at)))
        at = at[(kind == TYPES.index("INT")) | (kind == TYPES.index("FLOAT"))]
    number = vals.take(pa.array(at)).cast(pa.float64()).to_numpy()
    low, high = (np.array([ranges.get(c, (0, 0))[i] for c in names], dtype=np.float64)[row[at]] for i in (0, 1))
    return row[at], number, n[at], (number < low) | (number > high)


def _measurer(ids: Sequence[str], listed: Mapping[str, Sequence[str]], most_listed: int, ranges: Mapping[str, tuple[float, float]]):
    """mapInArrow body: kept counts -> sums that add up over the parts of a column, ends, and the median of a column in one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.num_rows
            row, vals, n = _flat(pa.Table.from_batches([b]))
            enc = vals.dictionary_encode()
            code = enc.indices.to_numpy()
            kind = _classes(enc.dictionary)[code] if len(vals) else np.zeros(0, np.int64)
            total = lambda w: np.bincount(row, weights=w, minlength=rows)
            filled = kind >= 0
            out = [total(n), total(n * filled), total(filled)]
            out += [total(n * (kind == i)) for i in range(len(TYPES))]
            n_log_n = total(np.where(filled, n * np.log2(np.maximum(n, 1)), 0.0))
            names = b.column("column_name").to_pylist()
            known = np.zeros((rows, most_listed))
            for c in {*names} & {*listed}:
                mine = np.isin(row, [i for i, x in enumerate(names) if x == c])
                slot = pc.index_in(enc.dictionary, value_set=pa.array(listed[c], pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)[code]
                hit = mine & (slot >= 0)
                np.add.at(known, (row[hit], slot[hit]), n[hit])
            at, number, times, beyond = _numbers(b, ranges)
            out.append(np.bincount(at, weights=times * beyond, minlength=rows))
            out += [known[:, i] for i in range(most_listed)]
            ends: list[list] = [[None] * rows for _ in range(3)]
            whole = b.column("parts").to_numpy() == 1
            for i in np.unique(at).tolist():
                mine = at == i
                ends[0][i], ends[1][i] = float(number[mine].min()), float(number[mine].max())
                if whole[i]:
                    ends[2][i] = _median(number[mine], times[mine])
            arrays = [pa.array(x.astype(np.int64)) for x in out] + [pa.array(n_log_n)] + [pa.array(x, pa.float64()) for x in ends]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in ids], *arrays], [*ids, *_sums(most_listed), "n_log_n", *_ENDS])

    return run


def _sums(most_listed: int) -> list[str]:
    return ["n_seen", "n_nonempty", "n_distinct", *[f"n_{t.lower()}" for t in TYPES], "n_beyond", *[f"k{i}" for i in range(most_listed)]]


_ENDS = ("min_number", "max_number", "median_number")


def _median(values: np.ndarray, counts: np.ndarray) -> float:
    """The median of values that occur ``counts`` times; of an even number the middle two's mean."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(counts[order])
    low, high = (upto[-1] - 1) // 2, upto[-1] // 2
    at = np.searchsorted(upto, [low, high], side="right")
    return float(values[order][at].mean())


def _ranged_medians(counts: DataFrame, ids: Sequence[str], ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(ids..., median_number) of columns in several parts; no task gets the numbers of a column."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, number, times, _ = _numbers(b, ranges)
            i = pa.array(at)
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(i) for k in ids], pa.array(number), pa.array(times.astype(np.int64))], [*ids, "__v", "__n"])

    schema = ", ".join(f"`{k}` {_kind(counts, k)}" for k in ids) + ", __v double, __n bigint"
    per = counts.mapInArrow(numbers, schema).groupBy(*ids, "__v").agg(F.sum("__n").alias("__n"))
    return group_quantiles(per, ids, "__v", "__n", 0.5, "median_number")


#: How far a column may depart from the accepted profile before it counts as changed.
LIMITS = {"filled_points": 10.0, "type_points": 8.0, "distinct_factor": 2.0, "unlisted_share": 0.05,
          "distance": 0.2, "median_factor": 2.0, "beyond_share": 0.05}
_EXACT = 1e-9  # shares at a limit to the last digit do not exceed it


def profiles(counts: DataFrame, ids: Sequence[str], report: DataFrame) -> DataFrame:
    """One row for each of ``ids`` (load and column, or column): its profile, and ``departs``: where from the accepted one.

    ``report`` is the accepted profile, one row per column; it has as many rows as the
    table has columns, which bounds what comes to the driver. ``distance`` is the
    total variation distance of value shares, ``entropy`` is in bits.
    """
    accepted = report.select("column_name", "n_nonempty", "pct_nonempty", "type_counts", "distinct_values",
                             "value_counts", "distinct_share", "min_number", "median_number", "max_number").collect()
    listed = {r.column_name: list(r.distinct_values) for r in accepted if r.distinct_values is not None}
    ranges = {r.column_name: (r.min_number, r.max_number) for r in accepted if r.median_number is not None}
    most_listed = max(map(len, listed.values()), default=0)
    kinds = ", ".join(f"`{k}` {_kind(counts, k)}" for k in ids)
    sums = _sums(most_listed)
    schema = ", ".join([kinds, *[f"{c} bigint" for c in sums], "n_log_n double", *[f"{c} double" for c in _ENDS]])
    measured = counts.mapInArrow(_measurer(ids, listed, most_listed, ranges), schema)
    cut = counts.filter("parts > 1")
    if not cut.isEmpty():
        measured = measured.unionByName(_ranged_medians(cut, ids, ranges), allowMissingColumns=True)
    p = measured.groupBy(*ids).agg(*[F.sum(c).alias(c) for c in (*sums, "n_log_n")], F.min("min_number").alias("min_number"),
                                   F.max("max_number").alias("max_number"), F.max("median_number").alias("median_number"))
    filled = F.col("n_nonempty")
    some = filled > 0
    p = (p.withColumn("pct_nonempty", 100.0 * filled / F.col("n_seen"))
         .withColumn("distinct_share", F.when(some, F.col("n_distinct") / filled))
         .withColumn("entropy", F.when(some, F.log2(filled.cast("double")) - F.col("n_log_n") / filled)))

    def case(value_of) -> F.Column:
        """A CASE over column_name of what the accepted profile says."""
        found = None
        for r in accepted:
            if (v := value_of(r)) is not None:
                found = (F.when if found is None else found.when)(F.col("column_name") == r.column_name, v)
        return F.lit(None).cast("double") if found is None else found

    distance, unlisted = None, None
    for r in accepted:
        if r.distinct_values is None:
            continue
        names = listed[r.column_name]
        held = r.value_counts or {}
        of = sum(held.values()) or 1
        gap = sum((F.abs(F.col(f"k{i}") / filled - held.get(v, 0) / of) for i, v in enumerate(names)), F.lit(0.0))
        out = (filled - sum((F.col(f"k{i}") for i in range(len(names))), F.lit(0))) / filled
        extra = sum(n for v, n in held.items() if v not in names) / of
        mine = F.col("column_name") == r.column_name
        distance = (F.when if distance is None else distance.when)(mine & some, (gap + out + extra) / 2)
        unlisted = (F.when if unlisted is None else unlisted.when)(mine & some, out)
    none = F.lit(None).cast("double")
    numbers = F.col("n_int") + F.col("n_float")
    p = (p.withColumn("distance", none if distance is None else distance)
         .withColumn("unlisted_share", none if unlisted is None else unlisted)
         .withColumn("beyond_share", F.when(case(lambda r: r.median_number).isNotNull() & (numbers > 0), F.col("n_beyond") / numbers))
         .withColumn("type_gap", F.when(some, F.greatest(*[
             F.abs(100.0 * F.col(f"n_{t.lower()}") / filled - case(lambda r, t=t: 100.0 * (r.type_counts or {}).get(t, 0) / r.n_nonempty if r.n_nonempty else None))
             for t in TYPES]))))
    share = case(lambda r: r.distinct_share if r.distinct_values is None else None)
    middle = case(lambda r: r.median_number)
    over = lambda x, most: x > most + _EXACT
    apart = lambda x, base, f: (x < base / f - _EXACT) | (x > base * f + _EXACT)
    tests = {
        "filled": over(F.abs(F.col("pct_nonempty") - case(lambda r: r.pct_nonempty)), LIMITS["filled_points"]),
        "types": over(F.col("type_gap"), LIMITS["type_points"]),
        "distinct": some & apart(F.col("distinct_share"), share, LIMITS["distinct_factor"]),
        "values": over(F.col("unlisted_share"), LIMITS["unlisted_share"]) | over(F.col("distance"), LIMITS["distance"]),
        "numbers": apart(F.col("median_number"), middle, LIMITS["median_factor"]) | over(F.col("beyond_share"), LIMITS["beyond_share"]),
    }
    departs = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]))
    return p.withColumn("departs", departs).select(
        *ids, "n_seen", "n_nonempty", "pct_nonempty", *[f"n_{t.lower()}" for t in TYPES], "n_distinct", "distinct_share",
        "min_number", "median_number", "max_number", "entropy", "unlisted_share", "distance", "beyond_share", "departs")


def load_profiles(rows: DataFrame, group: str, columns: Sequence[str], report: DataFrame) -> DataFrame:
    """The profile of every load and column, from the kept table that the loads' deltas make."""
    return profiles(maintain(None, load_deltas(rows, group, columns), group), [group, "column_name"], report)
