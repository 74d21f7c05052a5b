import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.operators import evaluation as E


@pytest.fixture(scope="module")
def matrix(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1_200):
        x, y = rng.random(), rng.choice([None, float("inf"), rng.random()])
        rows.append((i, dt.datetime(2021, 1, 1) + dt.timedelta(hours=i), x, y, rng.random() < 0.05, x > 0.8 or rng.random() < 0.05))
    df = spark.createDataFrame(rows, "code bigint, at timestamp_ntz, x double, y double, b boolean, bad boolean")
    split = E.walk_forward(df, "at", embargo_days=1)
    return E.model_matrix(split, ["x", "y", "b"], "bad").cache()


AP = """WITH g AS (SELECT score, sum(label) AS p, count(*) AS n FROM df GROUP BY 1), c AS (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g
  WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT sum(p * cp / cn) / sum(p) FROM c"""


def test_average_precision_of_written_scores(spark, matrix, tmp_path):
    found = {(r.fold, r.model): r for r in E.cross_validate(matrix, 2, F.col("x"), trees=4).collect()}
    assert set(found) == {(i, m) for i in (1, 2) for m in ("baseline", "logistic", "boosted")}
    for model in ("baseline", "logistic", "boosted"):
        a, b = found[1, model].average_precision, found[2, model].average_precision
        assert found[1, model].mean == pytest.approx((a + b) / 2) and found[1, model].deviation == pytest.approx(abs(a - b) / 2)
    train, valid = matrix.filter("train_1"), matrix.filter("valid_1")
    for name, scored in (("baseline", valid.select("label", F.col("x").alias("score"))), ("logistic", E.scores(E.fit_logistic(train), valid, ["label"]))):
        scored.write.parquet(str(tmp_path / name))
        assert duckdb.connect().execute(AP.replace("FROM df", f"FROM read_parquet('{tmp_path / name}/*.parquet')")).fetchone()[0] == pytest.approx(found[1, name].average_precision)
    assert (found[1, "boosted"].n_train, found[1, "boosted"].n_valid) == (train.count(), valid.count())


def test_boosting_stops_by_the_newest_rows(matrix):
    train, newest = E.newest_apart(matrix.filter("not is_holdout"), "at", 0.1)
    assert newest.agg(F.min("at")).first()[0] > train.agg(F.max("at")).first()[0]
    assert abs(newest.count() / (train.count() + newest.count()) - 0.1) < 0.01
    model = E.fit_boosted(train, newest, trees=15, depth=3)
    assert 1 <= model.getNumTrees <= 15
    got = E.scores(model, matrix.filter("is_holdout"), ["code"]).orderBy("code").collect()
    assert [r.code for r in got] == sorted(r.code for r in matrix.filter("is_holdout").collect()) and all(0 <= r.score <= 1 for r in got)


def test_one_class_teaches_nothing(matrix):
    found = {r.model: r.average_precision for r in E.cross_validate(matrix.withColumn("label", F.lit(0.0)), 1, F.col("x")).collect()}
    assert found == {"baseline": None, "logistic": None, "boosted": None}


def test_leakage_of_folds(matrix):
    got = {r.fold: r for r in E.leakage_folds(matrix, "at", "code", 3, 1).collect()}
    assert all(r.passed and r.gap_days >= 1 and r.shared_codes == 0 for r in got.values())
    same = matrix.withColumn("code", F.lit(7))
    assert not any(r.passed for r in E.leakage_folds(same, "at", "code", 3, 1).collect())
    assert not any(r.passed for r in E.leakage_folds(matrix, "at", "code", 3, 2).collect())
