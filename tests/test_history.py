import datetime as dt
import random
from statistics import median

import pytest

from tidemill.operators import history

T0 = dt.datetime(2021, 1, 1)


def brute(rows):
    out = {}
    for r in rows:
        earlier = [x[3] for x in rows if x[0] == r[0] and x[3] is not None and x[1] is not None and r[1] is not None and (x[1], x[2]) < (r[1], r[2])]
        out[r[2]] = median(earlier) if earlier else None
    return out


@pytest.mark.parametrize("stretch", [1, 3, 50, 20_000])
def test_prior_median_of_stretches(spark, stretch):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        who = "hot" if i % 3 else rng.choice(["a", "b", None])
        kind = rng.random()
        amount = None if kind < 0.1 else 100.0 if kind < 0.4 else -rng.random() * 5 if kind < 0.45 else round(rng.random() * 10 ** rng.randint(0, 6), 2)
        rows.append((who, None if rng.random() < 0.03 else T0 + dt.timedelta(minutes=rng.randint(0, 9_000)), i, amount))
    df = spark.createDataFrame(rows, "who string, at timestamp_ntz, code bigint, amount double").repartition(5)
    got = {r.code: r.m for r in history.prior_median(df, ["who"], "at", "code", "amount", "m", stretch).collect()}
    assert got == pytest.approx(brute(rows))


def test_prior_median_of_nothing(spark):
    df = spark.createDataFrame([], "who string, at timestamp_ntz, code bigint, amount double")
    assert history.prior_median(df, ["who"], "at", "code", "amount", "m").count() == 0


@pytest.mark.parametrize("stretch", [history.DAY_US, history.DAY_US // 64])
def test_trailing_windows(spark, stretch):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None, "b"]), None if i % 40 == 0 else T0 + dt.timedelta(hours=rng.choice([0, 1, 2, 24, 25, 48]), seconds=rng.choice([0, 0, 1])), i, rng.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "who string, at timestamp_ntz, code bigint, amount int").repartition(3)
    from pyspark.sql import functions as F

    hour = 3_600_000_000
    got = {r.code: r for r in history.trailing(df, ["who"], "at", "code", F.col("amount"), {"h": hour, "d": 24 * hour}, stretch).collect()}
    for who, at, code, _ in rows:
        for w, span in (("h", dt.timedelta(hours=1)), ("d", dt.timedelta(days=1))):
            inside = [x for x in rows if at is not None and x[1] is not None and x[0] == who and at - span < x[1] and (x[1], x[2]) <= (at, code)]
            assert got[code][f"n_{w}"] == len(inside) and got[code][f"units_{w}"] == sum(x[3] for x in inside)
    assert len(got) == len(rows)


def test_stretches_follow_the_number_of_rows(spark):
    df = spark.range(3_000).selectExpr("timestamp_micros(id * 28800000) AS at")
    assert history.stretch_of(df, "at") == history.DAY_US
    assert history.stretch_of(df, "at", most_rows=100) == history.DAY_US // 16
    assert history.stretch_of(df.limit(0), "at") == history.DAY_US


def test_running_day_totals_of_stretches(spark):
    from pyspark.sql import functions as F

    from tidemill.operators import budget

    df = spark.createDataFrame([("a" if i % 3 else None, T0 + dt.timedelta(minutes=7 * i), i, i / 4) for i in range(700)], "who string, at timestamp_ntz, code int, amount double")
    run = lambda s: sorted((r.code, r.t) for r in budget.running_day_total(df, ["who"], "at", "code", "amount", F.col("code") % 5 != 0, "t", stretch_us=s).collect())
    assert run(history.DAY_US) == run(history.DAY_US // 8)
