"""Behaviours and traps of the transaction pipeline on small fixtures."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import exprs
from tidemill.operators import budget, cleaning, evaluation, graph, history, scoring
from tidemill.operators.history import Carried

T = dt.datetime


def column(spark, expr, values, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


def test_merge_fraction(spark):
    df = spark.createDataFrame([("01/03/26 10:15:30", "123456789"), ("02/03/26 08:00:00", "0"), ("02/03/26 08:00:00", None), ("02/03/26 08:00:00", "x"),
                                ("31/02/23 10:00:00", "0"), ("01/01/69 00:00:00", "0"), ("1/1/21 0:0:0", "0"), (None, "5"), ("", "5")], "d string, f string")
    got = [r.t for r in df.select(exprs.merge_fraction("d", "f").alias("t")).collect()]
    assert got[0] == T(2026, 3, 1, 10, 15, 30, 123456) and got[1] == got[2] == got[3] == T(2026, 3, 2, 8)
    assert got[4] is None and got[5] == T(1969, 1, 1) and got[6:] == [None] * 3


def test_typing_keeps_fractions(spark):
    df = spark.createDataFrame([("01/03/26 10:15:30", "500", "50000.5", "1001", "x")], "d string, f string, amount string, code string, bad string")
    r = cleaning.cast_types(df, {"at": ("d", "f")}, ["amount", "bad"], ["code"]).first()
    assert (r.amount, r.code, r.bad, r.f) == (50000.5, 1001, None, "500") and "d" not in r.asDict()


def test_pdiv_levels_rounding(spark):
    assert column(spark, exprs.pdiv(F.lit(10.0), F.col("x")), [0.0, 4.0, None]) == [math.inf, 2.5, None]
    assert column(spark, exprs.pdiv(F.lit(0.0), F.col("x")), [0.0]) == [None]
    ranks = exprs.label(exprs.level(F.col("x"), budget.LEVELS), budget.LEVEL_NAMES)
    assert column(spark, ranks, [0.49, 0.5, 0.8, 0.95, 1.0, None, math.inf]) == ["none", "50%", "80%", "95%", "100%", "none", "100%"]
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r.s for r in scoring.weighted_score(df, {"x": 1.0}, "s").collect()] == [0, 2, 2]


def test_quarantine_takes_the_unknown(spark):
    df = spark.createDataFrame([(1, T(2021, 1, 1), 5.0), (2, None, 5.0), (3, T(2019, 1, 1), 5.0), (4, T(2021, 1, 1), None), (5, T(2021, 1, 1), 1e8)], "c int, at timestamp, a double")
    ok, bad = cleaning.quarantine(df, cleaning.usable_date("at"))
    assert [r.c for r in ok.orderBy("c").collect()] == [1, 4, 5] and [r.c for r in bad.orderBy("c").collect()] == [2, 3]
    assert [r.c for r in cleaning.quarantine(ok, cleaning.bounded("a"))[1].orderBy("c").collect()] == [4, 5]


def test_ranks_are_least_rank_over_n(spark):
    df = spark.createDataFrame([(i, v, v > 0) for i, v in enumerate([0.0, 0.0, 5.0, 7.0])], "i int, x double, m boolean")
    out = scoring.percent_rank_min(df, "x", "r")
    assert [r.r for r in out.orderBy("i").collect()] == [0.25, 0.25, 0.75, 1.0]
    masked = scoring.percent_rank_min(df, "x", "r", F.col("m"))
    assert [r.r for r in masked.orderBy("i").collect()] == [0, 0, 0.5, 1.0]
    flat = scoring.scale_min_max(df.withColumn("x", F.lit(3.0)), {"s": "x"})
    assert {r.s for r in flat.collect()} == {0.0}


def events(spark, rows):
    return spark.createDataFrame(rows, "code bigint, who string, dst string, at timestamp, amount double")


def hour(h, m=0):
    return T(2021, 1, 1) + dt.timedelta(hours=h, minutes=m)


def test_trailing_is_left_open_and_excludes_later_ties(spark):
    df = events(spark, [(1, "a", "", hour(0), 1.0), (2, "a", "", hour(1), 2.0), (3, "a", "", hour(1), 4.0), (4, "a", "", hour(2), 8.0)])
    out = history.trailing(df, ["who"], "at", "code", F.col("amount").cast("bigint"), {"w": 3_600_000_000}).orderBy("code").collect()
    assert [(r.n_w, r.units_w) for r in out] == [(1, 1), (1, 2), (2, 6), (1, 8)]


def random_events(n, seed, span_days=40):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["a", "a", "b", None]), rnd.choice(["a", "b", "c", "", None]),
             None if rnd.random() < 0.03 else T(2021, 1, 1) + dt.timedelta(minutes=rnd.randrange(span_days * 24) * 60), float(rnd.randrange(50))) for i in range(n)]


def test_history_against_brute_force(spark):
    rows = random_events(400, 1)
    df = events(spark, rows)
    got = {r.code: r for r in history.before(df, ["who"], "at", "code", {"s": Carried(F.col("amount")), "m": Carried(F.col("amount"), "max")}).collect()}
    tr = {r.code: r.n_w for r in history.trailing(df, ["who"], "at", "code", F.lit(1), {"w": 5 * 86_400_000_000}).collect()}
    first = {r.code: r.f for r in history.first_occurrence(df, ["who", "dst"], "at", "code", "f").collect()}
    median = {r.code: r.md for r in history.prior_median(df, ["who"], "at", "code", "amount", "md").filter("at is not null").collect()}
    assert len(got) == len(tr) == len(rows)
    for c, w, d, t, a in rows:
        earlier = [x for x in rows if x[1] == w and x[3] and t and (x[3], x[0]) < (t, c)]
        assert got[c].s == sum(x[4] for x in earlier) and got[c].m == max((x[4] for x in earlier), default=None)
        if t:
            assert tr[c] == 1 + sum(t - x[3] < dt.timedelta(5) for x in earlier)
            assert first[c] == (not any(x[2] == d for x in earlier))


def test_median_of_earlier_values(spark):
    df = events(spark, [(i, "a", "", hour(i), v) for i, v in enumerate([5.0, 1.0, 9.0, 3.0])] + [(9, "b", "", hour(0), 7.0)])
    out = {r.code: r.m for r in history.prior_median(df, ["who"], "at", "code", "amount", "m").collect()}
    assert out == {0: None, 1: 5.0, 2: 3.0, 3: 5.0, 9: None}


def test_asof_backward_is_strict(spark):
    left = events(spark, [(1, "a", "", hour(1), 0.0), (2, "a", "", hour(2), 0.0), (3, "b", "", hour(30), 0.0), (4, "z", "", hour(5), 0.0)])
    right = events(spark, [(7, "a", "", hour(1), 10.0), (8, "a", "", hour(0, 30), 20.0), (9, "b", "", hour(1), 30.0)]).select(
        F.col("code").alias("rc"), F.col("who").alias("rw"), F.col("at").alias("rt"), F.col("amount").alias("got"))
    out = {r.code: r.got for r in history.asof_backward(left, right, ("who", "rw"), ("at", "rt"), ("code", "rc"), ["got"]).collect()}
    assert out == {1: 20.0, 2: 10.0, 3: 30.0, 4: None}


def edges(spark, rows):
    df = spark.createDataFrame(rows, "code bigint, s string, d string, at timestamp, amount double")
    return graph.edges(df, "s", "d", "code", "at", "amount")


def circuits(spark, rows, **kw):
    return sorted((r.code_out, r.code_back) for r in graph.closed_circuits(edges(spark, rows), **kw).collect())


def test_circuits(spark):
    assert circuits(spark, [(1, "A", "B", hour(10), 1.0), (2, "B", "A", hour(10, 5), 1.0), (3, "C", "D", hour(10), 1.0)]) == [(1, 2)]
    assert circuits(spark, [(1, "A", "B", T(2021, 1, 1), 1.0), (2, "B", "A", T(2021, 2, 1), 1.0)]) == []
    assert circuits(spark, [(1, "A", "B", hour(1), 1.0), (2, "A", "B", hour(2), 1.0), (3, "B", "A", hour(3), 1.0)]) == [(2, 3)]
    assert circuits(spark, [(i, "A", "B", hour(i), 1.0) for i in range(51)] + [(99, "B", "A", hour(52), 1.0)]) == []


def test_pass_through(spark):
    rows = [("MULE", 0.95, 5.0)] * 5 + [("ONCE", 0.95, 5.0)] + [("SHOP", 0.05, 5.0)] * 10 + [("NONE", None, None)]
    out = {r.node: r for r in graph.pass_through(spark.createDataFrame(rows, "a string, r double, d double"), "a", "r", "d").collect()}
    assert (out["MULE"].n_quick, out["ONCE"].n_quick, out["SHOP"].n_quick, out["NONE"].n_quick) == (5, 1, 0, 0)
    assert out["MULE"].score > out["ONCE"].score > out["SHOP"].score == 0


def test_consumption_is_per_service_and_day(spark):
    rows = [("C1", "S6", T(2021, 1, 1, h), 10_000.0, ch) for h, ch in enumerate(["APP", "APP", "APP", "AGENT", "AGENT"])]
    df = spark.createDataFrame(rows, "who string, s string, at timestamp, a double, channel string")
    dims = budget.limits(spark.createDataFrame([(" s6 ", 20_000.0, 80_000.0)], "code string, unit double, daily double"), "code", ["unit", "daily"])
    r = budget.consumption(df, dims, "who", "s", "at", "a", "daily").collect()
    assert len(r) == 1 and (r[0].day_total, r[0].day_rate, r[0].day_left) == (50_000.0, 0.625, 30_000.0)
    x = budget.ratio_to_limit(df, dims, "s", "a", "unit").first()
    assert (x.ratio, x.above, x.distance) == (0.5, False, 10_000.0)


def test_leakage(spark):
    df = spark.createDataFrame([(i, T(2021, 1, d)) for i, d in enumerate([1, 2, 3, 10, 11, 12])], "code int, at timestamp")
    train, valid = df.filter("code < 3"), df.filter("code >= 3")
    assert evaluation.leakage_report(train, valid, "at", "code")["status"] == "PASS"
    for a, b, days in ((df.filter("code < 4"), valid, 1), (train, valid, 10), (train.unionByName(valid.limit(0)), valid.withColumn("code", F.lit(1)), 1)):
        with pytest.raises(evaluation.LeakageError):
            evaluation.leakage_report(a, b, "at", "code", days)


def test_average_precision_is_step_wise(spark):
    rnd = random.Random(3)
    rows = [(rnd.random() < 0.3, rnd.randrange(20) / 20) for _ in range(300)]
    pos, hit, seen, want = sum(r[0] for r in rows), 0, 0, 0.0
    for s in sorted({r[1] for r in rows}, reverse=True):
        new = sum(r[0] for r in rows if r[1] == s)
        hit, seen = hit + new, seen + sum(r[1] == s for r in rows)
        want += new / pos * hit / seen
    got = evaluation.average_precision(spark.createDataFrame(rows, "l boolean, s double"), "l", "s").first()[0]
    assert abs(got - want) < 1e-12


def test_features_do_not_know_the_future(spark):
    rows = random_events(200, 5)
    cut = T(2021, 1, 20)
    df = events(spark, rows)
    full = {r.code: r.asDict() for r in history.before(df, ["who"], "at", "code", {"s": Carried(F.col("amount"))}).filter(F.col("at") <= cut).collect()}
    part = {r.code: r.asDict() for r in history.before(df.filter(F.col("at") <= cut), ["who"], "at", "code", {"s": Carried(F.col("amount"))}).collect()}
    assert full == part
