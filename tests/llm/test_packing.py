import itertools
import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import packing as pk


def best(sizes, capacity):
    """The least number of containers, by trying all assignments."""
    for k in itertools.count(1 if sizes else 0):
        def place(i, rooms):
            if i == len(sizes):
                return True
            tried = set()
            for j, r in enumerate(rooms):
                if r >= sizes[i] and r not in tried:
                    tried.add(r)
                    if place(i + 1, (*rooms[:j], r - sizes[i], *rooms[j + 1:])):
                        return True
            return False
        if place(0, (capacity,) * k):
            return k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_and_packing_enclose_the_optimum(sizes):
    a = np.array(sizes, dtype=np.int64)
    place, used = pk.best_fit_decreasing(a, 20)
    filled = np.bincount(place, weights=a, minlength=used) if len(a) else np.zeros(0)
    assert (filled <= 20).all()
    assert pk.lower_bound(np.bincount(a, minlength=21), 20) <= best(sorted(sizes, reverse=True), 20) <= used


def test_bound_sees_more_than_the_total():
    assert pk.lower_bound(np.bincount([11] * 6, minlength=21), 20) == 6
    assert pk.lower_bound(np.bincount([7] * 6, minlength=21), 20) == 3


def check(df, capacity, **kw):
    want = defaultdict(int)
    for r in df.collect():
        want[r.doc_id] += max(r.n_tokens or 0, 0)
    out = pk.fill_containers(df, capacity=capacity, **kw).collect()
    boxes, docs = defaultdict(int), defaultdict(int)
    for r in out:
        assert 0 <= r.begin <= r.end and r.begin == r.piece * capacity and r.end - r.begin <= capacity
        boxes[r.container] += r.end - r.begin
        docs[r.doc_id] += r.end - r.begin
    assert docs == want and all(v <= capacity for v in boxes.values())
    return out, boxes


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")


def test_whole_documents_once(spark):
    rnd = random.Random(1)
    df = sizes(spark, [(i, rnd.choice([0, 3, 50, 100, 101, 250, 99, None])) for i in range(500)])
    out, boxes = check(df, 100)
    assert sum(r.piece == 0 for r in out) == 500
    for r in out:
        assert r.piece == 0 or r.begin >= 100


def test_groups_with_a_gap_exchange(spark):
    rnd = random.Random(4)
    df = sizes(spark, [(i, rnd.randrange(1, 100)) for i in range(1200)])
    _, small = check(df, 100, group_documents=40)
    _, one = check(df, 100, group_documents=10_000)
    assert len(one) <= len(small) <= len(one) * 1.1  # groups of forty are far too small to be packed well
    row = pk.packing_summary(pk.fill_containers(df, capacity=100, group_documents=40), 100).first()
    assert row.bound <= len(one) and row.containers == len(small) and row.unused == row.containers * 100 - row.tokens


def test_same_sizes_repeated_rows_nulls_and_empty(spark):
    check(sizes(spark, [(1, 60)] * 50 + [(None, 30)] * 20 + [(2, -5), (3, None)]), 100)
    assert pk.fill_containers(sizes(spark, [])).count() == 0
    out, boxes = check(sizes(spark, [(1, 0), (2, 0)]), 100)
    assert len(boxes) == 1
    check(sizes(spark, [(1, 1_000_000)]).withColumn("container", F.lit(1)).withColumn("g", F.lit(1)), 2048)
