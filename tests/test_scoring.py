import numpy as np
import pytest

from tidemill.operators import scoring


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_quantiles_are_exact(spark, q):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 40, 997).tolist(), rng.normal(size=997).tolist()
    df = spark.createDataFrame([(float(x), y if i % 3 else None, None) for i, (x, y) in enumerate(zip(a, b))], "a double, b double, c double").repartition(5)
    got = scoring.quantiles(df, ["a", "b", "c"], q).first()
    assert got[0] == pytest.approx(np.quantile(a, q)) and got[1] == pytest.approx(np.quantile([y for i, y in enumerate(b) if i % 3], q)) and got[2] is None


def test_scales_of_nothing(spark):
    df = spark.createDataFrame([], "a double, k int")
    assert scoring.scale_min_max(df, {"x": "a"}).count() == 0
    one = spark.createDataFrame([(None, 1), (3.0, 2)], "a double, k int")
    assert [r.x for r in scoring.scale_min_max(one, {"x": "a"}).collect()] == [0.0, 0.0]


def test_composites(spark):
    df = spark.createDataFrame([(1, 0.2, 0.9, None), (2, 1.0, 1.0, 1.0), (3, None, None, None)], "k int, a double, b double, c double")
    out = {r.k: (r.g, r.m) for r in scoring.composite(df, {"g": ("greatest", {"a": 1, "b": 1}), "m": ("mean", {"a": 1, "b": 1.5, "c": 1})}).collect()}
    assert out[1] == (0.9, pytest.approx((0.2 + 1.35) / 3)) and out[2] == (1.0, 1.0) and out[3] == (0.0, 0.0)
