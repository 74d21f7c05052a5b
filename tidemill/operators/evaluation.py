"""Splits in time, leakage checks, ranking metrics and reference models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.exprs import micros
from tidemill.operators.history import DAY_US
from tidemill.session import materialize


class LeakageError(ValueError):
    """Training rows know something of the rows they are judged on."""


def walk_forward(rows: DataFrame, ts: str, folds: int = 3, embargo_days: float = 1, holdout_share: float = 0.05) -> DataFrame:
    """The rows with ``is_holdout`` and ``train_i``, ``valid_i`` for each fold.

    The span before the holdout is cut into folds + 1 equal parts; fold i is judged on part
    i + 1 and trained on what is earlier by at least the embargo. Bounds come from one
    aggregated row, in whole microseconds.
    """
    span = rows.agg(F.min(micros(ts)).alias("__lo"), F.max(micros(ts)).alias("__hi"))
    us = micros(ts)
    lo, hi = F.col("__lo"), F.col("__hi")
    hold = hi - F.floor((hi - lo) * holdout_share)
    out = rows.crossJoin(span).withColumn("is_holdout", us >= hold)
    step = F.floor((hold - lo) / (folds + 1))
    embargo = int(embargo_days * DAY_US)
    for i in range(1, folds + 1):
        begin = lo + step * i
        end = lo + step * (i + 1) if i < folds else hold
        out = out.withColumn(f"train_{i}", us < begin - embargo).withColumn(f"valid_{i}", (us >= begin) & (us < end))
    return out.drop("__lo", "__hi")


def leakage_report(train: DataFrame, valid: DataFrame, ts: str, code: str, embargo_days: float = 1) -> dict:
    """Gap in days and shared codes; LeakageError if dates overlap, the gap is below the embargo or a code is in both."""
    t = train.agg(F.max(micros(ts))).first()[0]
    v = valid.agg(F.min(micros(ts))).first()[0]
    shared = train.select(code).join(valid.select(code), code, "left_semi").count()
    gap = (v - t) / DAY_US if t is not None and v is not None else None
    if gap is not None and gap <= 0:
        raise LeakageError("training dates reach into the validation dates")
    if gap is not None and gap < embargo_days:
        raise LeakageError(f"a gap of {gap:.3f} days is below the embargo of {embargo_days}")
    if shared:
        raise LeakageError(f"{shared} codes are in both")
    return {"status": "PASS", "gap_days": gap, "shared_codes": shared}


def average_precision(rows: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the step-wise average precision (tied scores are one step).

    Rows are first counted per distinct score, in ranges whose totals are carried along.
    """
    per = rows.filter(F.col(score).isNotNull()).groupBy((-F.col(score)).alias("__s")).agg(
        F.sum(F.col(label).cast("int")).alias("__p"), F.count(F.lit(1)).alias("__n"))
    ranged = materialize(per.repartitionByRange("__s").withColumn("__q", F.spark_partition_id()), "scored")
    parts = ranged.groupBy("__q").agg(F.sum("__p").alias("__pp"), F.sum("__n").alias("__nn"))
    first = Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = parts.select("__q", F.coalesce(F.sum("__pp").over(first), F.lit(0)).alias("__bp"), F.coalesce(F.sum("__nn").over(first), F.lit(0)).alias("__bn"))
    w = Window.partitionBy("__q").orderBy("__s").rowsBetween(Window.unboundedPreceding, 0)
    cum = ranged.withColumns({"__cp": F.sum("__p").over(w), "__cn": F.sum("__n").over(w)}).join(base, "__q")
    hit = F.col("__cp") + F.col("__bp")
    seen = F.col("__cn") + F.col("__bn")
    return cum.agg(F.sum(F.col("__p") * hit / seen).alias("__a"), F.sum("__p").alias("__t")).select(
        F.when(F.col("__t") > 0, F.col("__a") / F.col("__t")).alias("average_precision"))


def precision_recall(rows: DataFrame, label: str, score: str, thresholds: Sequence[float] = (0.1, 0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """Per threshold: alerts, true and false positives, precision, recall, F1 (0 where undefined). One pass over the rows."""
    positive = F.col(label).cast("int")
    aggs = [F.sum(positive).alias("pos")]
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= t
        aggs += [F.count(F.when(hit, 1)).alias(f"a{i}"), F.coalesce(F.sum(F.when(hit, positive)), F.lit(0)).alias(f"t{i}")]
    one = rows.agg(*aggs)
    items = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"a{i}").alias("alerts"), F.col(f"t{i}").alias("true_positives"), F.col("pos").alias("positives")) for i, t in enumerate(thresholds)])
    x = one.select(F.explode(items).alias("x")).select("x.*")
    p = F.when(F.col("alerts") > 0, F.col("true_positives") / F.col("alerts")).otherwise(0.0)
    r = F.when(F.col("positives") > 0, F.col("true_positives") / F.col("positives")).otherwise(0.0)
    return (x.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)))


def clipped_share(c: str, most: float = 5.0):
    """A baseline score: the value clipped to [0, most], over most; NULL is 0."""
    x = F.coalesce(F.col(c), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(most), x)) / most


def model_matrix(rows: DataFrame, features: Sequence[str], label: str | None, missing: float = -1.0) -> DataFrame:
    """A ``features`` vector: booleans as numbers, infinite and NULL values as ``missing``."""
    from pyspark.ml.feature import VectorAssembler

    number = {f: F.col(f).cast("double") for f in features}
    clean = rows.withColumns({f: F.when(F.isnan(c) | F.abs(c).isin(float("inf")) | c.isNull(), missing).otherwise(c) for f, c in number.items()})
    if label:
        clean = clean.withColumn("label", F.col(label).cast("double"))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(clean)


def balanced(rows: DataFrame) -> DataFrame:
    """``weight``: each class weighs half of the rows in all."""
    n = rows.agg(F.count(F.lit(1)).alias("__n"), F.sum("label").alias("__p"))
    w = F.when(F.col("label") == 1, F.col("__n") / (2 * F.col("__p"))).otherwise(F.col("__n") / (2 * (F.col("__n") - F.col("__p"))))
    return rows.crossJoin(n).withColumn("weight", w).drop("__n", "__p")


def fit_logistic(train: DataFrame, iterations: int = 50):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(weightCol="weight", maxIter=iterations, standardization=True, regParam=0.001).fit(balanced(train))


def fit_boosted(train: DataFrame, stop: DataFrame | None = None, trees: int = 40, depth: int = 5, step: float = 0.1, seed: int = 42):
    """Boosted trees; with ``stop``, rows not trained on, no further tree is added once their error no longer falls."""
    from pyspark.ml.classification import GBTClassifier

    model = GBTClassifier(weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed)
    rows = balanced(train)
    if stop is not None:
        rows = rows.withColumn("__stop", F.lit(False)).unionByName(balanced(stop).withColumn("__stop", F.lit(True)))
        model = model.setValidationIndicatorCol("__stop")
    return model.fit(rows.select("features", "label", "weight", *(["__stop"] if stop is not None else [])))


def newest_apart(rows: DataFrame, ts: str, share: float) -> tuple[DataFrame, DataFrame]:
    """(the rest, the newest ``share``), parted at a quantile of time."""
    cut = rows.select(micros(ts).alias("__us")).agg(F.percentile_approx("__us", 1 - share, 10_000)).first()[0]
    newest = F.coalesce(micros(ts) > F.lit(cut), F.lit(False))
    return rows.filter(~newest), rows.filter(newest)


def scores(model, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., score): the probability of the positive class. Order by an ordinal among ``keep`` to have the order of the input."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("score"))


def with_spread(folds: DataFrame, by: Sequence[str]) -> DataFrame:
    """The folds with ``mean`` and ``deviation`` (of the population) of their average precision."""
    w = Window.partitionBy(*by)  # one row a fold
    return folds.withColumn("mean", F.avg("average_precision").over(w)).withColumn("deviation", F.stddev_pop("average_precision").over(w))


def cross_validate(matrix: DataFrame, folds: int, baseline: Column, seed: int = 42, trees: int = 20) -> DataFrame:
    """(fold, model, n_train, n_valid, average_precision, mean, deviation) of a baseline score, a logistic and a boosted model.

    Boosting stops by the rows that are judged, as many trees as help. Where the training rows are of one class
    only, the models know nothing: their score is that of no row apart from another.
    """
    out = []
    spark = matrix.sparkSession
    for i in range(1, folds + 1):
        train, valid = matrix.filter(f"train_{i}"), matrix.filter(f"valid_{i}")
        n, positive = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
        judged = valid.count()
        some = valid.agg(F.sum("label")).first()[0] or 0
        flat = valid.select("label", F.lit(0.0).alias("score"))
        judge = {"baseline": valid.select("label", baseline.alias("score")), "logistic": flat, "boosted": flat}
        if 0 < positive < n:
            judge["logistic"] = scores(fit_logistic(train), valid, ["label"])
            judge["boosted"] = scores(fit_boosted(train, valid if 0 < some < judged else None, trees, seed=seed), valid, ["label"])
        for name, rows in judge.items():
            found = average_precision(rows, "label", "score").first()
            out.append((i, name, n, judged, found[0] if found else None))
    rows = spark.createDataFrame(out, "fold int, model string, n_train bigint, n_valid bigint, average_precision double")
    return with_spread(rows, ["model"])


def leakage_folds(split: DataFrame, ts: str, code: str, folds: int, embargo_days: float) -> DataFrame:
    """One row per fold: rows, the gap in days between training and judged rows, codes in both, whether that passes."""
    us = micros(ts)
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.col(f"train_{i}").alias("t"), F.col(f"valid_{i}").alias("v")) for i in range(1, folds + 1)]))
    x = split.select(F.col(code).alias("code"), us.alias("us"), sides.alias("s")).select("code", "us", "s.*")
    per = x.groupBy("fold").agg(F.count(F.when(F.col("t"), 1)).alias("n_train"), F.count(F.when(F.col("v"), 1)).alias("n_valid"),
                                ((F.min(F.when(F.col("v"), F.col("us"))) - F.max(F.when(F.col("t"), F.col("us")))) / float(DAY_US)).alias("gap_days"))
    both = x.filter(F.col("code").isNotNull()).groupBy("fold", "code").agg(F.max("t").alias("t"), F.max("v").alias("v")).filter("t and v")
    shared = both.groupBy("fold").agg(F.count(F.lit(1)).alias("shared_codes"))
    out = per.join(shared, "fold", "left").fillna(0, ["shared_codes"])
    return out.withColumn("passed", F.coalesce(F.col("gap_days") >= embargo_days, F.lit(True)) & (F.col("shared_codes") == 0))
