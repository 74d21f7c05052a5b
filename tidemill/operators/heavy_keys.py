"""Per-key counts and totals although a few keys hold most rows.

Every input split is encoded by a dictionary of its own and reduced into dense
accumulator arrays (numpy bincount), so a key costs a split one slot however many
rows it has. Slots are cut into blocks by a hash of the key, as many as the keys'
approximate number asks for; the blocks of all splits are summed block by block, into a
sum that holds each key of the block once. No task ever holds the rows of a key.

Defined cases: NULL is a key of its own; NULL, NaN and infinite values add nothing to
their total, the row still counts; an empty table gives an empty result; only the
named columns are read, so others may clash with result names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.redelivery import fixed_point

CHUNK_ROWS = 400_000  # rows that one round of encoding holds in memory
BLOCK_KEYS = 50_000  # keys of a block, about
SUM_ROWS = 500_000  # partial entries gathered before they are added to a block's sum
_LOW = 1 << 24


def _scatter_sum(codes: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of int64 values by code; two bincounts keep each part below 2**53."""
    high = values >> 24
    low = values & (_LOW - 1)
    return (np.bincount(codes, weights=high, minlength=size).astype(np.int64) * _LOW
            + np.bincount(codes, weights=low, minlength=size).astype(np.int64))


def _encode(keys: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Codes and dictionary of a key column; NULL has the last code."""
    enc = pa.chunked_array([keys.combine_chunks()]).dictionary_encode().combine_chunks()
    if isinstance(enc, pa.ChunkedArray):
        enc = enc.chunk(0)
    size = len(enc.dictionary)
    codes = enc.indices.fill_null(size).to_numpy(zero_copy_only=False)
    words = pa.concat_arrays([enc.dictionary, pa.nulls(1, enc.dictionary.type)])
    return codes, words


def _blocks_of(words: pa.Array, blocks: int) -> np.ndarray:
    filled = words.fill_null("").to_numpy(zero_copy_only=False).astype(object)
    return (pd.util.hash_array(filled, categorize=False) % np.uint64(blocks)).astype(np.int64)


def _split_accumulator(sides: Sequence[str], totals: Sequence[str], blocks: int):
    def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
        values = [np.nan_to_num(t.column(c).fill_null(0).to_numpy()).astype(np.int64) for c in totals]
        for side in sides:
            codes, words = _encode(t.column(side))
            n = np.bincount(codes, minlength=len(words)).astype(np.int64)
            sums = [_scatter_sum(codes, v, len(words)) for v in values]
            block = _blocks_of(words, blocks)
            order = np.argsort(block, kind="stable")
            order = order[n[order] > 0]
            if not len(order):
                continue
            ids, starts = np.unique(block[order], return_index=True)
            offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
            lists = [words.take(pa.array(order)), pa.array(n[order]), *[pa.array(s[order]) for s in sums]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([side] * len(ids)), pa.array(ids), *[pa.ListArray.from_arrays(offsets, x) for x in lists]],
                ["side", "block", "keys", "n", *totals])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK_ROWS:
                yield from flush(pa.Table.from_batches(held))
                held = []
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield from flush(t)

    return run


def _block_sum(totals: Sequence[str]):
    names = ["keys", "n", *totals]

    def reduced(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        codes, words = _encode(t.column("keys"))
        sums = [_scatter_sum(codes, t.column(c).to_numpy(), len(words)) for c in names[1:]]
        there = np.flatnonzero(sums[0] > 0)
        return pa.RecordBatch.from_arrays([words.take(pa.array(there)), *[pa.array(x[there]) for x in sums]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        side = None
        for b in batches:
            if b.num_rows:
                side = side or b.column("side")[0].as_py()
                held.append(pa.RecordBatch.from_arrays([b.column(c).flatten() for c in names], names))
            if sum(x.num_rows for x in held) >= SUM_ROWS + (held[0].num_rows if len(held) > 1 else 0):
                held = [reduced(held)]
        total = reduced(held)
        yield pa.RecordBatch.from_arrays([pa.array([side] * total.num_rows), *total.columns], ["side", "key", "n", *totals])

    return run


def per_key_totals(rows: DataFrame, sides: Sequence[str], amounts: Sequence[str],
                   decimals: int = 2, blocks: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """(side, key, n, total_<amount>...) for every key of each of the columns ``sides``.

    ``blocks``: into how many blocks a split's arrays are cut; a block of all splits is summed by
    one task. Default: by the approximate number of distinct keys, counted on ``keys`` if that has
    the same keys as ``rows`` and is cheaper to read.
    """
    spark = rows.sparkSession
    if blocks is None:
        found = (rows if keys is None else keys).agg(*[F.approx_count_distinct(c, 0.05).alias(c) for c in sides]).first()
        blocks = max(spark.sparkContext.defaultParallelism, -(-max(found) // BLOCK_KEYS))
    slim = rows.select(*sides, *[fixed_point(c, decimals).alias(f"__u_{c}") for c in amounts])
    units = [f"__u_{c}" for c in amounts]
    arrays = "side string, block bigint, keys array<string>, n array<bigint>" + "".join(f", `{u}` array<bigint>" for u in units)
    partial = slim.mapInArrow(_split_accumulator(sides, units, blocks), arrays)
    flat = "side string, key string, n bigint" + "".join(f", `{u}` bigint" for u in units)
    summed = partial.groupBy("side", "block").applyInArrow(_block_sum(units), flat)
    unit = float(10**decimals)
    return summed.select("side", "key", "n", *[(F.col(f"__u_{c}") / F.lit(unit)).alias(f"total_{c}") for c in amounts])
