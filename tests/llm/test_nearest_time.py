import random

import pytest

from tidemill.llm import nearest_time as nt

SCHEMA = "entity string, ns bigint, id bigint"


def brute(left, right, tol):
    out = []
    for e, t, i in left:
        if e is None or t is None or i is None:
            continue
        near = sorted((abs(rt - t), rt, ri) for re_, rt, ri in right if re_ == e and rt is not None and ri is not None and abs(rt - t) <= tol)
        out.append((i, near[0][2] if near else None, near[0][1] - t if near else None))
    return sorted(out, key=str)


def got(spark, left, right, tol, stretch, parts=3, batch=None):
    if batch:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        l = spark.createDataFrame(left, SCHEMA).repartition(parts)
        r = spark.createDataFrame(right, SCHEMA).repartition(parts)
        return sorted(((x.left_id, x.right_id, x.gap_ns) for x in nt.nearest(l, r, tol, stretch).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("batch", [7, 10_000])
def test_brute_force(spark, seed, batch):
    rnd = random.Random(seed)
    names = ["hot"] * 6 + ["a", "b", None]
    left = [(rnd.choice(names), rnd.choice([None, *range(0, 400)]) if rnd.random() < 0.05 else rnd.randrange(400), i) for i in range(300)]
    right = [(rnd.choice(names), None if rnd.random() < 0.05 else rnd.randrange(0, 400), 1000 + i % 250) for i in range(250)]
    left += left[:20] + [("a", 5, None)]
    right += right[:20] + [("a", 5, None)]
    assert got(spark, left, right, 3, 20, batch=batch) == brute(left, right, 3)


def test_tolerance_is_inclusive_and_ties_take_the_earlier(spark):
    left = [("a", 100, 1), ("b", 100, 2), ("c", 100, 3), ("d", 100, 4)]
    right = [("a", 10, 7), ("b", 9, 8), ("c", 95, 9), ("c", 105, 5), ("d", 100, 6), ("d", 100, 2)]
    assert got(spark, left, right, 90, 1000) == [(1, 7, -90), (2, None, None), (3, 9, -5), (4, 2, 0)]


def test_a_hot_entity_without_partners(spark):
    left = [("hot", i, i) for i in range(2_000)]
    assert got(spark, left, [("hot", -500, 1)], 3, 100, batch=50) == brute(left, [("hot", -500, 1)], 3)


def test_empty(spark):
    assert got(spark, [], [("a", 1, 1)], 3, 10) == [] and got(spark, [("a", 1, 1)], [], 3, 10) == [(1, None, None)]
    with pytest.raises(ValueError):
        nt.nearest(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA), 10, 5)


def test_names_and_times(spark):
    df = spark.createDataFrame([(" Tel 1\t2 ", "01/01/00 00:00:01", 5), ("  ", "31/02/21 00:00:00", None), (None, "1/1/21 00:00:00", 1), ("x", "01/01/00 00:00:00", None)],
                               "p string, d string, f bigint")
    r = df.select(nt.plain_entity("p").alias("e"), nt.instant_ns("d", "f").alias("t")).collect()
    assert [x.e for x in r] == ["tel12", None, None, "x"] and [x.t for x in r] == [946_684_801 * 10**9 + 5, None, None, 946_684_800 * 10**9]
