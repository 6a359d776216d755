import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators.calibration import (
    apply_calibrators, apply_isotonic, apply_sigmoid, calibrated_mean, fit_calibrators, fit_isotonic, fit_sigmoid,
)


def max_min(s, y):
    """Isotonic fit at the distinct scores by its definition."""
    xs = np.unique(s)
    w = np.array([np.sum(s == x) for x in xs], float)
    t = np.array([np.sum(y[s == x]) for x in xs], float)
    n = len(xs)
    return xs, np.array([
        max(min(t[j:k + 1].sum() / w[j:k + 1].sum() for k in range(i, n)) for j in range(i + 1)) for i in range(n)])


def frame(spark, sizes, seed=0, digits=2):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in sizes.items():
        s = np.round(rng.normal(size=n), digits)
        y = (rng.random(n) < 1 / (1 + np.exp(-1.5 * s + 0.3))).astype(int)
        rows += [(g, float(a), int(b)) for a, b in zip(s, y)]
    return spark.createDataFrame(rows, "g string, score double, y int"), rows


def test_isotonic_equals_definition_for_all_groups(spark):
    df, rows = frame(spark, {"big": 800, "small": 9}, digits=1)
    fitted = fit_isotonic(df, ["g"])
    got = apply_isotonic(df.select("g", "score").distinct(), fitted, ["g"]).collect()
    for g in ("big", "small"):
        s = np.array([r[1] for r in rows if r[0] == g])
        y = np.array([r[2] for r in rows if r[0] == g])
        xs, want = max_min(s, y)
        mine = dict((r["score"], r["p"]) for r in got if r["g"] == g)
        assert np.allclose([mine[x] for x in xs], want, atol=1e-12)
        assert np.all(np.diff([mine[x] for x in xs]) >= 0)


def test_isotonic_does_not_depend_on_partitioning(spark):
    df, _ = frame(spark, {"big": 2000}, seed=5, digits=6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for parts in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            row = fit_isotonic(df, ["g"]).first()
            results.append((list(row["xs"]), list(row["ys"])))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0][0] == results[1][0] and np.allclose(results[0][1], results[1][1], atol=1e-12)


def test_isotonic_interpolates_and_clips(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1)], "score double, y int")
    points = spark.createDataFrame([(-5.0,), (0.0,), (0.25,), (1.0,), (9.0,)], "score double")
    got = [r["p"] for r in apply_isotonic(points, fit_isotonic(df, []), []).orderBy("score").collect()]
    assert got == [0.0, 0.0, 0.25, 1.0, 1.0]
    falling = spark.createDataFrame([(0.0, 1), (1.0, 0)], "score double, y int")
    got = [r["p"] for r in apply_isotonic(points, fit_isotonic(falling, []), []).collect()]
    assert got == [0.5] * 5


def test_sigmoid_is_the_minimum_of_platts_loss(spark):
    df, rows = frame(spark, {"a": 500, "b": 40})
    fitted = {r["g"]: (r["a"], r["b"]) for r in fit_sigmoid(df, ["g"]).collect()}
    for g, (a, b) in fitted.items():
        s = np.array([r[1] for r in rows if r[0] == g])
        y = np.array([r[2] for r in rows if r[0] == g])
        hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
        t = np.where(y == 1, hi, lo)
        p = 1 / (1 + np.exp(a * s + b))
        # at the minimum the gradient vanishes
        assert abs(np.sum((t - p) * s)) < 1e-6 and abs(np.sum(t - p)) < 1e-6
        assert a < 0


def test_sigmoid_survives_separable_and_one_class_scores(spark):
    rows = [("sep", -400.0, 0), ("sep", 400.0, 1), ("one", 0.3, 0), ("one", 0.7, 0)]
    df = spark.createDataFrame(rows, "g string, score double, y int")
    fitted = fit_sigmoid(df, ["g"])
    p = {(r["g"], r["score"]): r["p"] for r in apply_sigmoid(df, fitted, ["g"]).collect()}
    assert 0 < p["sep", -400.0] < 0.5 < p["sep", 400.0] < 1
    assert p["one", 0.3] == p["one", 0.7] < 0.5


def test_inner_models_are_averaged_then_classified(spark):
    df, _ = frame(spark, {"m": 400})
    rows = df.withColumn("inner", (F.rand(1) < 0.5).cast("int"))
    fitted = fit_calibrators(rows, ["g"])
    points = spark.createDataFrame([("m", 1, -2.0, -1.0), ("m", 2, 0.5, 2.0)], "g string, row_id int, s0 double, s1 double")
    got = apply_calibrators(points, fitted, ["g"], ["s0", "s1"]).collect()
    assert len(got) == 4
    long = points.select("g", "row_id", F.explode(F.array(
        F.struct(F.lit(0).alias("inner"), F.col("s0").alias("score")),
        F.struct(F.lit(1).alias("inner"), F.col("s1").alias("score")))).alias("e")).select("g", "row_id", "e.*")
    for method, fit, apply in (("sigmoid", fit_sigmoid, apply_sigmoid), ("isotonic", fit_isotonic, apply_isotonic)):
        slow = calibrated_mean(apply(long, fit(rows, ["g", "inner"]), ["g", "inner"]), ["row_id"])
        want = {r["row_id"]: (r["p"], r["yhat"]) for r in slow.collect()}
        for r in got:
            if r["calibration"] == method:
                assert r["p"] == pytest.approx(want[r["row_id"]][0]) and r["yhat"] == want[r["row_id"]][1]
