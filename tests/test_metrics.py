import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators.metrics import (
    CV_METRICS, EVALUATION_METRICS, classification_metrics, cv_summary, cv_wide, fold_scores, highest, prevalence,
    reliability_curve, roc_auc,
)


def test_undefined_ratios_are_zero(spark):
    rows = [("none", 1, 0), ("none", 0, 0), ("notrue", 0, 1), ("notrue", 0, 0), ("right", 1, 1), ("right", 0, 0)]
    df = spark.createDataFrame(rows, "g string, y int, yhat int")
    got = {r["g"]: r.asDict() for r in classification_metrics(df, ["g"]).collect()}
    assert [got["none"][m] for m in EVALUATION_METRICS] == [0.5, 0, 0, 0]
    assert [got["notrue"][m] for m in EVALUATION_METRICS] == [0.5, 0, 0, 0]
    assert [got["right"][m] for m in EVALUATION_METRICS] == [1, 1, 1, 1]
    with pytest.raises(ValueError):
        classification_metrics(df, ["g"], metrics=["kappa"])


def test_macro_averages_over_the_labels_that_occur(spark):
    df = spark.createDataFrame([("only0", 0, 0), ("mix", 1, 1), ("mix", 1, 0), ("mix", 0, 0)], "g string, y int, yhat int")
    got = {r["g"]: r for r in classification_metrics(
        df, ["g"], metrics=["precision_macro", "recall_macro", "balanced_accuracy"]).collect()}
    assert tuple(got["only0"])[1:] == (1.0, 1.0, 1.0)
    assert got["mix"]["precision_macro"] == pytest.approx((1 + 0.5) / 2)
    assert got["mix"]["recall_macro"] == pytest.approx((0.5 + 1) / 2)
    assert got["mix"]["balanced_accuracy"] == got["mix"]["recall_macro"]


def _brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    if not len(pos) or not len(neg):
        return math.nan
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))


@pytest.mark.parametrize("log2_slices", [1, 4, 9])
def test_auc_equals_pair_counting(spark, log2_slices):
    rng = np.random.default_rng(1)
    rows = []
    for g, n in (("big", 900), ("small", 7), ("one_class", 5)):
        y = rng.integers(0, 2, n) if g != "one_class" else np.zeros(n, int)
        p = np.where(rng.random(n) < 0.4, 0.25, np.round(rng.random(n), 3))  # one score holds 40 % of the rows
        rows += [(g, int(a), float(b)) for a, b in zip(y, p)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    got = {r["g"]: r["roc_auc"] for r in roc_auc(df, ["g"], log2_slices=log2_slices).collect()}
    for g, value in got.items():
        y = np.array([r[1] for r in rows if r[0] == g])
        p = np.array([r[2] for r in rows if r[0] == g])
        want = _brute_auc(y, p)
        assert (math.isnan(value) and math.isnan(want)) or value == pytest.approx(want, abs=1e-12)
    assert roc_auc(df.withColumn("p", F.col("y").cast("double")), []).first()[0] == 1.0


def test_one_class_fold_is_nan_on_all_metrics_and_in_the_mean(spark):
    rows = [(0, 1, 1, 0.9), (0, 0, 0, 0.1), (1, 0, 0, 0.2), (1, 0, 1, 0.8)]
    df = spark.createDataFrame([("m", *r) for r in rows], "model string, fold int, y int, yhat int, p double")
    scores = fold_scores(df, ["model"])
    by_fold = {r["fold"]: r for r in scores.collect()}
    assert all(by_fold[0][m] == 1.0 for m in CV_METRICS)
    assert all(math.isnan(by_fold[1][m]) for m in CV_METRICS)
    summary = cv_summary(scores, ["model"])
    row = summary.where("metric = 'f1'").first()
    assert row["raw"][0] == 1.0 and math.isnan(row["raw"][1]) and math.isnan(row["mean"])
    assert math.isnan(cv_wide(summary, ["model"]).first()["accuracy"])


def test_unfitted_model_scores_nan(spark):
    rows = [("m", 0, 1, 0, math.nan), ("m", 0, 0, 0, math.nan)]
    df = spark.createDataFrame(rows, "model string, fold int, y int, yhat int, p double")
    assert all(math.isnan(fold_scores(df, ["model"]).first()[m]) for m in CV_METRICS)


def test_reliability_bins(spark):
    ps = [0.0, 0.05, 0.1, 0.15, 0.5, 0.55, 0.95, 1.0]
    df = spark.createDataFrame([(int(p > 0.5), p) for p in ps], "y int, p double")
    rows = {r["bin"]: r for r in reliability_curve(df, []).collect()}
    # the widened edges put an exact 0.1 or 0.5 into the bin below
    assert {b: r["n"] for b, r in rows.items()} == {0: 3, 1: 1, 4: 1, 5: 1, 9: 2}
    assert rows[9]["mean_score"] == pytest.approx(0.975) and rows[9]["positive_share"] == 1.0


def test_prevalence_and_highest(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,), (0,), (0,), (0,), (0,)], "y1 int")
    assert tuple(prevalence(df, [], ["y1"]).first()) == (8, 1, 12.0)  # 12.5 goes to the even side
    t = spark.createDataFrame([("a", 0.1, 0.9, 0.2, 0.3), ("a", 0.95, 0.0, 0.0, 0.0)],
                              "g string, accuracy double, f1 double, precision double, recall double")
    assert highest(t, ["g"]).first()["highest"] == 0.95
