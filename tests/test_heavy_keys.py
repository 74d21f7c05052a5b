from collections import defaultdict

from pyspark.sql import functions as F

from tidemill.operators import heavy_keys as hk


def brute(rows):
    out = defaultdict(lambda: [0, 0])
    for a, b, v in rows:
        for side, key in (("a", a), ("b", b)):
            out[side, key][0] += 1
            out[side, key][1] += round(v * 100) if v is not None and v == v else 0
    return {k: (n, s / 100) for k, (n, s) in out.items()}


def got(df, **kw):
    return {(r.side, r.key): (r.n, r.total_v) for r in hk.per_key_totals(df, ["a", "b"], ["v"], **kw).collect()}


def test_brute_force_with_a_hot_key_and_nulls(spark, monkeypatch):
    rows = [("hot" if i % 3 else f"k{i % 50}", None if i % 4 == 0 else f"d{i % 7}", None if i % 5 == 0 else i / 4) for i in range(5_000)]
    rows += [("big", "big", 1e12), ("big", "big", -1e12 + 0.25), ("", "", float("nan")), (None, None, None)] * 3
    df = spark.createDataFrame(rows, "a string, b string, v double").repartition(5)
    want = brute(rows)
    assert got(df) == want
    assert got(df, blocks=1) == want
    assert got(df.withColumn("n", F.lit(9)).withColumn("keys", F.lit(9)).withColumn("block", F.lit(9))) == want


def test_empty(spark):
    assert got(spark.createDataFrame([], "a string, b string, v double")) == {}


def test_all_keys_null_in_every_row(spark):
    assert got(spark.createDataFrame([(None, None, 1.0)] * 10, "a string, b string, v double")) == {("a", None): (10, 10.0), ("b", None): (10, 10.0)}


def test_partial_sums_are_added_batch_by_batch(spark, monkeypatch):
    import pyarrow as pa

    from tidemill.operators import heavy_keys as H

    monkeypatch.setattr(H, "SUM_ROWS", 3)
    batches = [pa.RecordBatch.from_pydict({"side": ["s"], "block": [0], "keys": [["a", None, f"k{i % 4}"]], "n": [[1, 2, 3]], "u": [[10, -20, 30]]}) for i in range(12)]
    (out,) = H._block_sum(["u"])(iter(batches))
    assert {r["key"]: (r["n"], r["u"]) for r in out.to_pylist()} == {"a": (12, 120), None: (24, -240), **{f"k{i}": (9, 90) for i in range(4)}}
