import datetime as dt
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from tidemill.operators import rolling
from tidemill.operators.redelivery import latest_rows

E = ["who", "what"]
D = dt.date


def rows(spark, data):
    return spark.createDataFrame(
        [(w, s, dt.datetime(d.year, d.month, d.day, 13) if d else None, a) for w, s, d, a in data],
        "who string, what string, at timestamp, amount double")


def brute(data, first, last):
    day_sum, day_n = defaultdict(int), defaultdict(int)
    for w, s, d, a in data:
        if d and d.year >= 2020 and a is not None and a == a and abs(a) != float("inf"):
            day_sum[w, s, d] += round(a * 100)
            day_n[w, s, d] += 1
    out = {}
    for w, s in {(x[0], x[1]) for x in data}:
        for i in range((last - first).days + 1):
            d = first + dt.timedelta(i)
            r = []
            for p in (7, 30):
                span = [d - dt.timedelta(j) for j in range(p)]
                total, n = sum(day_sum[w, s, x] for x in span), sum(day_n[w, s, x] for x in span)
                r += [total / 100, total / 100 / n if n else None]
            out[w, s, d] = tuple(r)
    return out


DATA = [
    ("a", "x", D(2021, 1, 1), 10.0), ("a", "x", D(2021, 1, 1), 2.5), ("a", "x", D(2021, 1, 8), 1.0), ("a", "x", D(2021, 2, 20), 4.0),
    ("a", "y", D(2021, 1, 31), None), ("a", "y", D(2021, 2, 1), float("nan")), ("b", "x", None, 7.0), ("b", None, D(2003, 1, 1), 5.0),
    (None, "x", D(2021, 1, 3), 3.0), (None, "x", D(2021, 1, 3), 3.0), (None, None, D(2021, 2, 21), 1e12), ("a", "x", D(2021, 1, 7), float("inf")),
]


def backfilled(df):
    daily = rolling.daily_amounts(df, E, "at", "amount")
    return {(r.who, r.what, r.day): (r.sum_7d, r.avg_7d, r.sum_30d, r.avg_30d) for r in rolling.backfill(daily, E).collect()}


def test_backfill_is_brute_force(spark):
    assert backfilled(rows(spark, DATA)) == brute(DATA, D(2021, 1, 1), D(2021, 2, 21))


def test_many_entities_cross_batches(spark):
    data = [(f"p{i % 3001}", f"s{i % 2}", D(2021, 1, 1) + dt.timedelta(i * 7 % 61), i % 97 / 4) for i in range(20_000)]
    assert backfilled(rows(spark, data)) == brute(data, D(2021, 1, 1), D(2021, 3, 2))


def test_extra_and_clashing_columns_are_not_read(spark):
    df = rows(spark, DATA).withColumn("day", F.lit("no")).withColumn("units", F.lit(1)).withColumn("n", F.lit(1)).withColumn("s7", F.lit(1))
    assert backfilled(df) == brute(DATA, D(2021, 1, 1), D(2021, 2, 21))


def test_empty(spark):
    df = rows(spark, [])
    out = rolling.backfill(rolling.daily_amounts(df, E, "at", "amount"), E)
    assert out.columns == ["who", "what", "day", "sum_7d", "avg_7d", "sum_30d", "avg_30d"] and out.count() == 0


def test_no_usable_date_at_all(spark):
    df = rows(spark, [("b", "x", None, 7.0)])
    assert rolling.backfill(rolling.daily_amounts(df, E, "at", "amount"), E).count() == 0


def test_advance_day_by_day_equals_backfill(spark):
    daily = rolling.daily_amounts(rows(spark, DATA), E, "at", "amount").cache()
    want = brute(DATA, D(2021, 1, 1), D(2021, 2, 21))
    state = rolling.state_on(daily, E, "2021-01-06")
    for day in ("2021-01-07", "2021-01-08", "2021-01-09"):
        state = rolling.materialize(rolling.advance(state, daily, E, day), "state")
        got = {(r.who, r.what): (r.sum_7d, r.avg_7d, r.sum_30d, r.avg_30d) for r in rolling.totals(state, E).collect()}
        assert got == {(w, s): v for (w, s, d), v in want.items() if str(d) == day}


def test_corrections_make_versions_of_affected_days_only(spark):
    late = [("a", "x", D(2021, 1, 5), 100.0), ("new", "x", D(2021, 2, 1), 8.0)]
    back = [("a", "x", D(2021, 1, 8), 1.0)]
    days = [str(D(2021, 1, 1) + dt.timedelta(i)) for i in range(52)]
    daily = rolling.daily_amounts(rows(spark, DATA), E, "at", "amount").cache()
    states = rolling.state_on(daily, E, days[0])
    for d in days[1:]:
        states = states.unionByName(rolling.state_on(daily, E, d))
    plus = rolling.daily_amounts(rows(spark, late), E, "at", "amount")
    minus = rolling.daily_amounts(rows(spark, back), E, "at", "amount").withColumns({"units": -F.col("units"), "n": -F.col("n")})
    fixed = rolling.correct(states, plus.unionByName(minus), E, days[-1], version=1)
    touched = {(r.who, str(r.day)) for r in fixed.collect()}
    assert ("a", "2021-01-05") in touched and ("a", "2021-02-06") in touched and ("a", "2021-02-07") not in touched and ("a", "2021-01-04") not in touched
    now = rolling.totals(rolling.current(states.unionByName(fixed), E), E)
    got = {(r.who, r.what, r.day): (r.sum_7d, r.avg_7d, r.sum_30d, r.avg_30d) for r in now.collect()}
    after = [x for x in DATA if x != back[0]] + late
    want = brute(after, D(2021, 1, 1), D(2021, 2, 21))
    for k, v in got.items():
        assert v == want[k]
    assert ("new", "x", D(2021, 2, 1)) in got


def test_latest_rows(spark):
    t = lambda h: dt.datetime(2021, 1, 1, h)
    df = spark.createDataFrame(
        [(1, t(1), "a"), (1, t(3), "b"), (1, t(2), "c"), (2, t(1), "d"), (2, t(1), "d"), (3, None, "e"), (None, t(1), "f"), (None, t(1), "f"), (None, t(1), "g")],
        "code bigint, at timestamp, v string")
    got = sorted(((r.code, r.v) for r in latest_rows(df, "code", "at", ["v"]).collect()), key=str)
    assert got == [(1, "b"), (2, "d"), (3, "e"), (None, "f"), (None, "g")]
    assert latest_rows(df.limit(0), "code", "at", ["v"]).count() == 0


def test_late_and_redelivered_rows_reach_the_query_as_corrections(spark, tmp_path, monkeypatch):
    from tidemill.plans import training as tr

    t = lambda day, h=1: dt.datetime(2021, 3, day, h)
    data = [(1, t(10), "a", "x", t(9), 5.0), (1, t(28), "a", "x", t(9), 7.0), (2, t(11), "a", "x", t(27), 1.0), (3, t(29), "new", "x", t(25), 2.0),
            (4, t(29), None, "x", None, 3.0), (None, t(29), "a", "x", t(27), 4.0), (5, t(27), "b", "y", t(28), 8.0)]
    spark.createDataFrame(data, "transaction_code bigint, loaded_at timestamp_ntz, source_phone string, service_code string, "
                          "transaction_date timestamp_ntz, transaction_amount double").write.parquet(str(tmp_path / "transactions.parquet"))
    calls = []
    correct = rolling.correct
    monkeypatch.setattr(rolling, "correct", lambda states, deltas, *a, **k: calls.append(deltas.count()) or correct(states, deltas, *a, **k))
    got = {(r.source_phone, r.service_code, r.day): r.sum_30d for r in tr.QUERIES["p1_corrected"](spark, str(tmp_path)).collect()}
    every = {(r.source_phone, r.service_code, r.day): r.sum_30d for r in tr.p1_totals(spark, str(tmp_path)).collect()}
    assert got == {k: v for k, v in every.items() if k[2] >= D(2021, 3, 25)} and len(got) == 16
    assert got["a", "x", D(2021, 3, 28)] == 12.0 and calls and calls[0] > 0


def test_dates_after_the_last_delivery_are_not_usable(spark):
    df = spark.createDataFrame([("a", "s", dt.datetime(2021, 1, 2), 1.0), ("a", "s", dt.datetime(2099, 1, 1), 2.0)], "k string, s string, at timestamp_ntz, amount double")
    got = {r.day: r.units for r in rolling.daily_amounts(df, ["k", "s"], "at", "amount", last="2021-01-02").collect()}
    assert got == {dt.date(2021, 1, 2): 100, None: 200}


def test_corrections_read_touched_states_only(spark):
    states = rolling.state_on(spark.createDataFrame([("a", dt.date(2021, 1, 1), 5, 1), (None, dt.date(2021, 1, 1), 7, 1)], "k string, day date, units bigint, n bigint"), ["k"], "2021-01-01")
    deltas = spark.createDataFrame([(None, dt.date(2021, 1, 1), -7, -1)], "k string, day date, units bigint, n bigint")
    got = rolling.correct(states, deltas, ["k"], "2021-01-01", 1).collect()
    assert [(r.k, r.s7, r.n30, r.version) for r in got] == [(None, 0, 0, 1)]


def test_backfill_hands_over_states_not_days():
    rows = pa.RecordBatch.from_pydict({"k": pa.array([None, "a", "a"]), "day": pa.array([None, 9_995, 3], pa.int32()).cast(pa.date32()),
                                       "units": pa.array([1, 7, 5]), "n": pa.array([1, 1, 1])})
    out = pa.Table.from_batches(rolling.backfill_runner(["k"], 0, 10_000, (7, 30))(iter([rows])))
    assert out.nbytes < 1_000
    assert [tuple(r.values()) for r in out.to_pylist()] == [
        (None, 0, 10_000, 0, 0, 0, 0), ("a", 0, 3, 0, 0, 0, 0), ("a", 3, 7, 5, 1, 5, 1), ("a", 10, 23, 0, 0, 5, 1), ("a", 33, 9_962, 0, 0, 0, 0), ("a", 9_995, 5, 7, 1, 7, 1)]
