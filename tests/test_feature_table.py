import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.operators import feature_table as ft

T = dt.datetime


def frame(spark, rows):
    return spark.createDataFrame(rows, "who string, s string, p string, at timestamp, amount double, fee double, k int, n int")


def build(df, **kw):
    return ft.feature_table(df, "who", ["s", "p"], "at", ["amount", "fee"], **kw)


def brute(rows):
    n, last, a, f = defaultdict(int), {}, {}, {}
    for who, s, p, at, amount, fee, *_ in rows:
        key = who, f"{s or 'null'}__{p or 'null'}"
        n[key] += 1
        if at and at.year >= 2020:
            last[key] = max(last.get(key, at.date()), at.date())
        for table, v in ((a, amount), (f, fee)):
            if v is not None:
                table[key] = table.get(key, 0) + round(v * 100)
    return {k: (n[k], last.get(k), *[x[k] / 100 if k in x else None for x in (a, f)]) for k in n}


def check(df, rows, **kw):
    got, want = {}, brute(rows)
    types = {x[1] for x in want}
    out = build(df, **kw)
    for r in out.collect():
        for t in types:
            v = tuple(r[ft.column_name(kind, t)] for kind in ("n", "last", "amount", "fee"))
            if v[0] is not None:
                got[r.who, t] = v
            else:
                assert v == (None,) * 4
    assert got == want
    assert out.count() == len({r[0] for r in rows})


ROWS = [("a", "S1", "P1", T(2021, 1, 1, 5), 1.5, 0.1, 1, 2), ("a", "S1", "P1", T(2021, 1, 3), 2.5, None, 1, 2), ("a", "S1", None, None, None, None, 1, 2),
        (None, "S2", "P1", T(2003, 1, 1), 3.0, 1.0, None, None), (None, "S2", "P1", T(2021, 1, 1), 3.0, 1.0, None, None), ("b", None, "P2", T(2021, 5, 5), 0.1, 0.2, 1, 2)]


def test_brute_force(spark):
    check(frame(spark, ROWS), ROWS)


def test_blocks_do_not_matter(spark):
    rows = [(f"u{i % 501}", f"S{i % 7}", f"P{i % 11}", T(2021, 1, 1) + dt.timedelta(i % 90), i / 4, i / 2, 1, 1) for i in range(9_000)]
    check(frame(spark, rows), rows, block_types=5)


def test_hot_entity(spark):
    rows = [("hot" if i % 3 else f"u{i}", f"S{i % 5}", "P", T(2021, 1, 1), 1.0, 1.0, 1, 1) for i in range(3_000)]
    check(frame(spark, rows), rows)


def test_empty_and_clashes(spark):
    assert build(frame(spark, [])).columns == ["who"] and build(frame(spark, [])).count() == 0
    check(frame(spark, ROWS).withColumn("t", F.lit(1)).withColumn("last", F.lit(1)).withColumn("u0", F.lit(1)), ROWS)
    with pytest.raises(ValueError):
        build(frame(spark, [("a", "S-1", "P", None, 1.0, 1.0, 1, 1), ("a", "S+1", "P", None, 1.0, 1.0, 1, 1)]))


def test_a_catalogue_fixes_the_columns(spark):
    types = ["S1__P1", "S9__P9"]
    want = ["who", *[f"{k}__{t}" for t in (*types, "other") for k in ("n", "last", "amount", "fee")]]
    got = {r.who: r for r in build(frame(spark, ROWS), types=types).collect()}
    assert build(frame(spark, []), types=types).columns == want == build(frame(spark, ROWS), types=types).columns
    assert got["a"].n__S1__P1 == 2 and got["a"].n__other == 1 and got["a"].n__S9__P9 is None and got["b"].n__other == 1 and got[None].n__other == 2
    assert got[None].amount__other == 6.0 and build(frame(spark, []), types=types).count() == 0


def test_blocks_are_joined_without_an_exchange(spark, capsys):
    build(frame(spark, ROWS), block_types=2).explain()
    plan = capsys.readouterr().out
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
