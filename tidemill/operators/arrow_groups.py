"""Whole groups out of a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def changes(columns: Sequence[pa.Array]) -> np.ndarray:
    """Whether each row's key differs from that of the row before (the first: yes)."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for col in columns:
        codes = col.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], groups: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, starts): up to ``groups`` whole groups at a time, and where each begins.

    Rows must be sorted by ``keys``. Held in memory are a few batches and the longest
    group, so callers bound the rows of a group before (one a day, one a type...).
    """
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table, last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        starts = np.flatnonzero(changes([t.column(c).combine_chunks() for c in keys]))
        ends = np.append(starts, t.num_rows) if last else starts
        for i in range(0, len(ends) - 1, groups):
            j = min(i + groups, len(ends) - 1)
            yield t.slice(int(ends[i]), int(ends[j] - ends[i])), starts[i:j] - ends[i]
        held[:] = [] if last else t.slice(int(starts[-1])).combine_chunks().to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * groups:
                yield from cut(pa.Table.from_batches(held), False)
    if held:
        yield from cut(pa.Table.from_batches(held), True)
