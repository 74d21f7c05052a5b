"""One row per entity with count, recency and totals for each of hundreds of event types.

Events are aggregated by (entity, type), partially before the exchange. The types are
cut into blocks; every block is one folder of a table bucketed by entity and is
aggregated by entity on its own, each entity's cells of the block gathered into one
row. The blocks are joined onto the complete table of entities, bucketed alike, so
neither the aggregations nor the joins exchange anything. What is joined are a few
lists for each block; they are laid out as columns batch by batch at the end, so a
thousand columns cost no code generation.

Defined cases: a NULL entity is an entity of its own, NULL in a type column is a type
of its own ("null" in its name); an entity without a type's events has NULL in its
columns; NULL amounts add nothing (a total of only NULL amounts is NULL); rows
without a usable date still count, but not for the last date; with a declared catalogue
of types the columns are those of the catalogue in its order, whatever the events hold, and
events of types outside it are counted in a last type, ``other``; without one the types are those of
the events, and an empty table gives an empty result with the entity column only. Extra
columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.exprs import NO_KEY, key
from tidemill.operators.redelivery import fixed_point
from tidemill.operators.rolling import FIRST_YEAR
from tidemill.session import bucketed, materialize

BLOCK_TYPES = 64
MOST_TYPES = 5_000  # column names are kept by the driver: more types are an error, not dropped
BUCKET_CELLS = 500_000  # cells (entity and type) of a bucket, about
OTHER = "other"


def type_name(parts: Sequence[str]) -> Column:
    """The name of an event type: its parts, NULL as ``null``, joined by two underscores."""
    return F.concat_ws("__", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in parts])


def column_name(kind: str, event_type: str) -> str:
    """A column name without the characters that would need quoting."""
    return f"{kind}__{re.sub(r'[^0-9A-Za-z_]', '_', event_type)}"


def event_types(events: DataFrame, parts: Sequence[str]) -> list[str]:
    """The distinct type names, sorted; an error beyond MOST_TYPES."""
    found = events.select(type_name(parts).alias("t")).distinct().limit(MOST_TYPES + 1).collect()
    if len(found) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} event types: not a table of features")
    return sorted(r.t for r in found)


def event_cells(events: DataFrame, entity: str, parts: Sequence[str], ts: str, amounts: Sequence[str],
                types: Sequence[str] | None = None, decimals: int = 2, first_year: int = FIRST_YEAR) -> DataFrame:
    """(k, t, n, last, u0, u1...): count, last day and totals of each entity and type, in long form.

    Totals are in whole units. ``types``: a catalogue; what is outside it has the type ``other``.
    """
    day = F.when(F.year(ts) >= first_year, F.to_date(ts)).alias("last")
    t = type_name(parts)
    if types is not None:
        t = F.when(t.isin(*types), t).otherwise(OTHER)
    slim = events.select(key(entity).alias("k"), t.alias("t"), day, *[fixed_point(c, decimals).alias(f"u{i}") for i, c in enumerate(amounts)])
    return slim.groupBy("k", "t").agg(
        F.count(F.lit(1)).alias("n"), F.max("last").alias("last"), *[F.sum(f"u{i}").alias(f"u{i}") for i in range(len(amounts))])


def _layout(types: int, block_types: int, kinds: Sequence[str], divisors: Sequence[float]):
    """mapInArrow body: an entity's lists of each block's cells -> its dense columns."""

    def columns(cells: pa.ListArray, count: int, members: int) -> list[pa.Array]:
        lengths = cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = cells.flatten()
        slot = flat.field("slot").to_numpy(zero_copy_only=False) * count + np.repeat(np.arange(count), lengths)
        dense, empty = {}, {}
        for kind, divisor in zip(kinds, divisors):
            there = flat.field(kind)
            if pa.types.is_date(there.type):
                there = there.cast(pa.int32())
            value = there.fill_null(0).to_numpy(zero_copy_only=False)
            dense[kind] = np.zeros(members * count, dtype=value.dtype)
            dense[kind][slot] = value
            empty[kind] = np.ones(members * count, dtype=bool)
            empty[kind][slot] = there.is_null().to_numpy(zero_copy_only=False)
            if divisor:
                dense[kind] = dense[kind] / divisor
        out = []
        for i in range(members):
            part = slice(i * count, (i + 1) * count)
            for kind in kinds:
                col = pa.array(dense[kind][part], mask=empty[kind][part])
                out.append(col.cast(pa.date32()) if kind == "last" else col)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = [b.column("k")]
            for i in range(0, types, block_types):
                wide += columns(b.column(f"c{i // block_types}"), b.num_rows, min(block_types, types - i))
            yield pa.RecordBatch.from_arrays(wide, [str(i) for i in range(len(wide))])

    return run


def feature_table(events: DataFrame, entity: str, parts: Sequence[str], ts: str, amounts: Sequence[str],
                  decimals: int = 2, block_types: int = BLOCK_TYPES, first_year: int = FIRST_YEAR,
                  types: Sequence[str] | None = None, buckets: int | None = None) -> DataFrame:
    """entity, then ``n__T, last__T, <amount>__T...`` for every event type T of the catalogue, or of the events."""
    cells = materialize(event_cells(events, entity, parts, ts, amounts, types, decimals, first_year), "feature-cells")
    named = event_types(cells, ["t"]) if types is None else [*types, OTHER]
    units = [f"u{i}" for i in range(len(amounts))]
    kinds = dict(zip(["n", "last", *units], ["n", "last", *amounts]))
    names = [column_name(name, t) for t in named for name in kinds.values()]
    if len(set(names)) < len(names) or entity in names:
        raise ValueError("two columns of the feature table have the same name")
    sql_types = ["bigint", "date", *["double"] * len(units)]
    schema = ", ".join([f"`{entity}` string", *[f"`{column_name(name, t)}` {kind}" for t in named for name, kind in zip(kinds.values(), sql_types)]])

    buckets = buckets or max(events.sparkSession.sparkContext.defaultParallelism, -(-cells.count() // BUCKET_CELLS))
    place = events.sparkSession.createDataFrame([(t, i) for i, t in enumerate(named)], "t string, i int")  # MOST_TYPES rows at most
    laid = bucketed(cells.join(F.broadcast(place), "t").select("k", *kinds, (F.col("i") % block_types).alias("slot"), F.floor(F.col("i") / block_types).cast("int").alias("block")),
                    "feature-blocks", "k", buckets, "block")
    joined = bucketed(cells.select("k").distinct(), "feature-entities", "k", buckets)
    cell = F.struct("slot", *kinds)
    for b in range(0, len(named), block_types):
        c = b // block_types
        block = laid.filter(F.col("block") == c).groupBy("k").agg(F.collect_list(cell).alias(f"c{c}"))  # at most block_types cells
        joined = joined.join(block.hint("merge"), "k", "left")
    divisors = [0.0, 0.0, *[float(10**decimals)] * len(units)]
    joined = joined.withColumn("k", F.when(F.col("k") != NO_KEY, F.col("k")))
    return joined.mapInArrow(_layout(len(named), block_types, list(kinds), divisors), schema)
