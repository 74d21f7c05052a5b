import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemill.operators import profile as P

COLS = ["x", "y"]
REPORT = "column_name string, n_nonempty bigint, pct_nonempty double, type_counts map<string,bigint>, distinct_values array<string>, value_counts map<string,bigint>, distinct_share double, min_number double, median_number double, max_number double"


@pytest.fixture(scope="module")
def report(spark):
    return spark.createDataFrame([("x", 100, 100.0, {"INT": 100}, None, None, 0.5, 1.0, 50.0, 100.0),
                                  ("y", 90, 90.0, {"OTHER": 90}, ["A", "B"], {"A": 45, "B": 45}, 0.02, None, None, None)], REPORT)


def rows(spark, data):
    return spark.createDataFrame(data, "load int, x string, y string, part string, vals int")


LOADS = ([(1, str(i % 50 + 30), "A" if i % 2 else "B", None, 1) for i in range(100)]
         + [(2, "" if i % 2 else str(i), None if i < 50 else "A", None, 1) for i in range(100)]
         + [(3, f"{i}.5" if i % 2 else "abc", "C" if i < 10 else "AB"[i % 2], None, 1) for i in range(100)]
         + [(None, None, None, None, None)] * 3)


IDS = ["load", "column_name"]


def kept(df, **kw):
    return P.maintain(None, P.load_deltas(df, "load", COLS, **kw), "load")


def counted(df):
    return {(r[0], r.column_name): dict(zip(r.vals, r.counts)) for r in df.collect()}


def test_deltas_are_value_counts(spark):
    got = counted(kept(rows(spark, LOADS).repartition(7)))
    for load in (1, 2, 3, None):
        for i, c in enumerate(COLS):
            assert got[load, c] == Counter((r[1 + i] or "") for r in LOADS if r[0] == load)


def test_a_big_load_is_cut_by_value_and_measures_the_same(spark, report):
    df = rows(spark, LOADS).repartition(3)
    whole = P.profiles(kept(df), IDS, report)
    cut = kept(df, big_group=20)
    assert cut.filter("part > 0").count() > 0
    key = lambda r: str((r["load"], r["column_name"]))
    rounded = lambda d: sorted([{**r.asDict(), "entropy": r.entropy and round(r.entropy, 9)} for r in d.collect()], key=key)
    assert rounded(P.profiles(cut, IDS, report)) == rounded(whole)


def test_metrics(spark, report):
    out = {(r.load, r.column_name): r for r in P.load_profiles(rows(spark, LOADS), "load", COLS, report).collect()}
    x1, y1, x2, y2, x3, y3 = out[1, "x"], out[1, "y"], out[2, "x"], out[2, "y"], out[3, "x"], out[3, "y"]
    assert (x1.n_seen, x1.n_nonempty, x1.n_int, x1.n_distinct, x1.median_number, x1.min_number, x1.max_number) == (100, 100, 100, 50, 54.5, 30.0, 79.0)
    assert abs(x1.entropy - math.log2(50)) < 1e-9 and y1.distance == 0 and x1.departs == [] and y1.departs == []
    assert x2.departs == ["filled"] and y2.departs == ["filled", "values"] and y2.distance == 0.5
    assert x3.n_float == 50 and x3.n_other == 50 and set(x3.departs) == {"types"}
    assert y3.unlisted_share == 0.1 and y3.departs == ["values"]
    none = out[None, "x"]
    assert none.pct_nonempty == 0 and none.entropy is None and none.departs == ["filled"] and none.distinct_share is None


@pytest.mark.parametrize("big", [P.BIG_GROUP, 30])
def test_taking_a_load_back(spark, report, big):
    one = rows(spark, [r for r in LOADS if r[0] in (1, None)])
    two = rows(spark, [r for r in LOADS if r[0] == 2])
    first = kept(one, big_group=big)
    both = P.maintain(first, P.load_deltas(two, "load", COLS, kept=first, big_group=big), "load")
    # The parts of the load are those it is kept in, whatever the size of what is taken back.
    half = P.maintain(both, P.load_deltas(two.filter("x = ''"), "load", COLS, sign=-1, kept=both), "load")
    back = P.maintain(half, P.load_deltas(two.filter("x <> ''"), "load", COLS, sign=-1, kept=half), "load")

    def flat(df):
        return {(r.load, r.column_name, v): n for r in df.collect() for v, n in zip(r.vals, r.counts)}

    assert flat(back) == flat(first) and flat(both)[2, "y", "A"] == 50
    assert back.filter("load = 2").count() == 0


def test_all_loads_together(spark, report, monkeypatch):
    df = rows(spark, LOADS)
    table = kept(df)
    whole = P.profiles(P.over_all_loads(table), ["column_name"], report).collect()
    x = next(r for r in whole if r.column_name == "x")
    assert x.n_seen == len(LOADS) and x.n_distinct == len({r[1] for r in LOADS if r[1]}) and x.departs
    monkeypatch.setattr(P, "CELLS_PER_PART", 7)
    cut = P.over_all_loads(table)
    assert cut.filter("part > 0").count() > 0
    key = lambda r: r["column_name"]
    same = lambda rs: [{**r.asDict(), "entropy": round(r.entropy, 9)} for r in sorted(rs, key=key)]
    assert same(P.profiles(cut, ["column_name"], report).collect()) == same(whole)


def test_many_listed_values(spark):
    names = [f"v{i}" for i in range(33)]
    wide = spark.createDataFrame([("x", 33, 100.0, {"OTHER": 33}, names, {v: 1 for v in names}, 1.0, None, None, None)], REPORT)
    got = P.load_profiles(rows(spark, [(1, v, None, None, 1) for v in names]), "load", ["x"], wide).collect()
    assert got[0].distance == 0 and got[0].departs == []


def test_empty_and_long(spark, report):
    assert P.load_profiles(rows(spark, []), "load", COLS, report).count() == 0
    long = P.load_profiles(rows(spark, [(1, "z" * 300_000, "A", None, 1)]), "load", COLS, report).collect()
    assert {r.column_name: r.n_distinct for r in long} == {"x": 1, "y": 1}
    clash = rows(spark, LOADS).withColumn("column_name", F.lit(1)).withColumn("counts", F.lit(1))
    assert P.load_profiles(clash, "load", COLS, report).count() == 8
