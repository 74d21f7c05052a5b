"""Filling containers of fixed capacity with documents, with certified bounds.

Documents are spread over groups; every group is packed by best-fit decreasing, and
dual-feasible functions bound from below how many containers any packing of the group
needs. A group at its bound is done. Groups with a gap exchange their documents (they
are spread anew over fewer, larger groups) and are packed again, as long as that saves
containers. Only sizes travel, never texts.

Defined cases: a document longer than a container is cut into full containers and one
rest, any other stays whole; a document of no tokens takes no room and goes into a
container beside others (into an empty one only if its group has none); a negative or
NULL size counts as 0; repeated rows are packed each; an empty table gives an empty
result. Only the identifier and the size are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import materialize

CAPACITY = 2048
GROUP_DOCUMENTS = 40_000  # of the first round; each round's groups are GROWTH times as large
GROWTH = 4
MOST_GROUP_DOCUMENTS = 640_000  # what one task packs, in memory
STEPS = 64  # how many rounding functions are tried for a bound


def lower_bound(histogram: np.ndarray, capacity: int = CAPACITY) -> int:
    """How many containers any packing needs, by dual-feasible functions.

    ``histogram[s]`` is how many items have size s, up to the capacity. Each function maps
    sizes so that whatever fits a container still does; the mapped total, in containers,
    is then a bound. Tried are the identity, the functions that round sizes above
    ``capacity - a`` up and drop those below ``a``, and those that round to multiples.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    h = histogram.astype(np.int64)
    up = lambda a, b: -(-int(a) // int(b))
    best = up((h * x).sum(), capacity)
    size_upto = np.cumsum(h * x)
    count_upto = np.cumsum(h)
    a = np.arange(1, capacity // 2 + 1)
    large = count_upto[-1] - count_upto[capacity - a]
    middle = size_upto[capacity - a] - size_upto[a - 1]
    if len(a):
        best = max(best, up((large * capacity + middle).max(), capacity))
    for k in range(1, STEPS):
        scaled = (k + 1) * x
        mapped = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, up((h * mapped).sum(), capacity * k))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(container of each item, containers): largest first, each into the fullest that has room.

    ``free`` is a set of bits, one for every amount of room that some container has.
    """
    place = np.zeros(len(sizes), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, used = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = free >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            box = by_room[room].pop()
            if not by_room[room]:
                free &= ~(1 << room)
        else:
            room, box = capacity, used
            used += 1
        room -= size
        by_room[room].append(box)
        free |= 1 << room
        place[i] = box
    return place, used


_ROWS = "piece bigint, begin bigint, end bigint, container bigint, gap bigint, used bigint"


def _packer(id_col: str, capacity: int, round_no: int):
    def pack(t: pa.Table) -> pa.Table:
        ids = t.column(id_col).combine_chunks()
        group = t.column("g")[0].as_py()
        n = np.maximum(t.column("n").fill_null(0).to_numpy().astype(np.int64), 0)
        order = np.lexsort((pa.compute.rank(ids, "ascending", tiebreaker="dense").to_numpy(), -n))
        ids, n = ids.take(pa.array(order)), n[order]
        full, rest = n // capacity, n % capacity
        packed = np.flatnonzero((rest > 0) | (full == 0))
        place, used = best_fit_decreasing(rest[packed], capacity)
        bound = lower_bound(np.bincount(rest[packed], minlength=capacity + 1), capacity)
        whole = np.repeat(np.arange(len(n)), full)
        nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        doc = np.concatenate([packed, whole])
        piece = np.concatenate([full[packed], nth])
        box = np.concatenate([place, used + np.arange(len(whole))]) + (round_no << 56) + (group << 32)
        begin = piece * capacity
        gap = used - max(bound, 1 if used else 0)
        total = used + len(whole)
        cols = [pa.array(x.astype(np.int64)) for x in (n[doc], piece, begin, np.minimum(begin + capacity, n[doc]), box)]
        cols += [pa.array(np.full(len(doc), x, dtype=np.int64)) for x in (gap, total)]
        return pa.table([ids.take(pa.array(doc)), pa.array(np.full(len(doc), group, dtype=np.int64)), *cols],
                        names=[id_col, "g", "n", "piece", "begin", "end", "container", "gap", "used"])

    return pack


def fill_containers(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY,
                    group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """(id, piece, begin, end, container): where each piece of each document goes.

    ``begin`` and ``end`` are positions in the document's tokens. The rounds end when all
    groups meet their bounds, when an exchange saves nothing, or when groups have
    reached the size that one task packs.
    """
    kind = sizes.schema[id_col].dataType.simpleString()
    left = materialize(sizes.select(id_col, F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint").alias("n")), "sizes")
    done: DataFrame | None = None
    best: DataFrame | None = None
    best_used, round_no, target = None, 0, group_documents
    while True:
        count = left.count()
        groups = max(1, -(-count // target))
        spread = left.withColumn("g", F.pmod(F.xxhash64(id_col, "n", F.lit(round_no)), F.lit(groups)))
        packed = materialize(spread.groupBy("g").applyInArrow(
            _packer(id_col, capacity, round_no), f"`{id_col}` {kind}, g bigint, n bigint, {_ROWS}"), f"packed-{round_no}")
        by_group = packed.groupBy("g").agg(F.max("used").alias("used"), F.max("gap").alias("gap"))
        total = by_group.agg(F.sum("used"), F.count(F.when(F.col("gap") > 0, 1)), F.sum(F.when(F.col("gap") > 0, F.col("used")))).first()
        used, open_groups, open_used = total[0] or 0, total[1], total[2] or 0
        if best is not None and used >= best_used:
            last = best  # the exchange saved nothing
            break
        closed = packed.filter("gap <= 0")
        best, best_used = packed.filter("gap > 0"), open_used
        done = closed if done is None else done.unionByName(closed)
        last = best
        if not open_groups or groups == 1 or target >= MOST_GROUP_DOCUMENTS:
            break
        left = best.filter("piece = 0").select(id_col, "n")
        target = min(target * GROWTH, MOST_GROUP_DOCUMENTS)
        round_no += 1
    return done.unionByName(last).select(id_col, "piece", "begin", "end", "container")


def packing_summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers used, the bound no packing can beat, tokens and unused room.

    The bound is taken over all items at once; their histogram has ``capacity + 1`` entries.
    """
    pieces = packed.select((F.col("end") - F.col("begin")).alias("size"))
    counts = pieces.groupBy("size").count().collect()
    h = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts:
        h[size] = n
    tokens = int((h * np.arange(capacity + 1)).sum())
    return packed.agg(
        F.countDistinct("container").alias("containers"), F.lit(lower_bound(h, capacity)).cast("bigint").alias("bound"),
        F.lit(tokens).cast("bigint").alias("tokens")).withColumn("unused", F.col("containers") * capacity - F.col("tokens"))
