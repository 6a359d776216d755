import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import order_key
from cohortlens.operators.features import assemble, fit_fill_values, impute, outside_range, standardize
from cohortlens.operators.orderstats import exact_medians, group_medians
from cohortlens.operators.subgroups import Registry, Subgroup
from cohortlens.operators.split import inner_folds, split_train_test, stratified_folds


def dealt_folds(labels, k):
    """Folds of an ordered label list, the slow way: deal the class-sorted rows round robin, cut classes in blocks."""
    first = list(dict.fromkeys(labels))
    by_class = sorted(labels, key=first.index)
    sizes = {c: [sum(1 for x in by_class[i::k] if x == c) for i in range(k)] for c in first}
    left = {c: [f for f in range(k) for _ in range(sizes[c][f])] for c in first}
    return [left[c].pop(0) for c in labels]


def ordered(spark, n, seed=13):
    return [r["id"] for r in spark.range(n).orderBy(order_key("id", seed)).collect()]


@pytest.mark.parametrize("n", [1, 7, 100, 1001])
def test_split_size_is_exact_and_takes_the_first_keys(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    got = {r["row_id"]: r["is_test"] for r in split_train_test(df).collect()}
    want = math.ceil(0.33 * n)
    assert sum(got.values()) == want
    assert [got[i] for i in ordered(spark, n)] == [True] * want + [False] * (n - want)


def test_hash_split_and_folds_are_close_to_their_share(spark):
    df = spark.range(20000).withColumnRenamed("id", "row_id").withColumn("y", F.lit(1))
    share = split_train_test(df, mode="hash").agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert share == pytest.approx(0.33, abs=0.02)
    sizes = [r["count"] for r in stratified_folds(df, "y", 5, mode="hash").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 500
    with pytest.raises(ValueError):
        split_train_test(df, mode="none")


@pytest.mark.parametrize("k,positives", [(3, 4), (2, 1), (5, 3), (5, 50)])
def test_folds_equal_dealing_by_hand(spark, k, positives):
    n = 101
    label = lambda i: int(i % n < positives)
    df = spark.createDataFrame([(i, label(i)) for i in range(n)], "row_id long, y int")
    got = {r["row_id"]: r["fold"] for r in stratified_folds(df, "y", k).collect()}
    order = ordered(spark, n)
    want = dealt_folds([label(i) for i in order], k)
    assert [got[i] for i in order] == want
    sizes = np.bincount(want, minlength=k)
    assert sizes.max() - sizes.min() <= 1


def test_fold_number_may_differ_by_group(spark):
    rows = [(i, g, i % 2, 2 if g == "a" else 3) for i in range(60) for g in "ab"]
    df = spark.createDataFrame(rows, "row_id long, g string, y int, k int")
    got = stratified_folds(df, "y", "k", ["g"]).groupBy("g", "fold").count().collect()
    assert {(r["g"], r["fold"]): r["count"] for r in got} == {
        ("a", 0): 30, ("a", 1): 30, ("b", 0): 20, ("b", 1): 20, ("b", 2): 20}


def test_inner_folds_leave_out_the_held_out_part(spark):
    df = spark.createDataFrame([(i, i % 4 == 0) for i in range(50)], "row_id long, b boolean")
    df = stratified_folds(df.select("row_id", F.col("b").cast("int").alias("y")), "y", 5, fold="outer")
    got = inner_folds(df, "y", outer="outer", n_outer=5)
    assert got.where("held_out = outer").count() == 0
    assert got.count() == 50 * 4
    sizes = [r["count"] for r in got.groupBy("held_out", "inner").count().collect()]
    assert len(sizes) == 10 and set(sizes) == {20}


def test_medians_are_exact_with_nulls_ties_and_groups(spark):
    rng = np.random.default_rng(3)
    n = 3000
    a = rng.normal(size=n)
    b = np.where(rng.random(n) < 0.7, 0.0, rng.random(n))  # one value holds most rows
    rows = [("x" if i % 3 else "y", float(a[i]) if i % 10 else None, float(b[i]), None) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, a double, b double, empty double")
    got = exact_medians(df, ["a", "b", "empty"], ["g"]).orderBy("g").collect()
    want = df.groupBy("g").agg(*[F.median(c) for c in ("a", "b", "empty")]).orderBy("g").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert exact_medians(df, ["a"]).first()[0] == df.agg(F.median("a")).first()[0]
    four = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (11.0,)], "v double")
    assert exact_medians(four, ["v"]).first()[0] == 6.0


def test_medians_of_extreme_values(spark):
    values = [-1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1 / 3, 2.5, 1e300, float("inf"), float("-inf"), 7.0]
    rows = [(k, v) for k in range(1, len(values) + 1) for v in values[:k]] + [(None, 4.0), (0, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    got = {r["k"]: r["v"] for r in exact_medians(df, ["v"], ["k"]).collect()}
    for k in range(1, len(values) + 1):
        v = sorted(values[:k])
        assert got[k] == (v[(k + 1) // 2 - 1] + v[k // 2]) / 2, k
    assert got[None] == 4.0 and got[0] is None and len(got) == len(values) + 2
    assert exact_medians(df.where("k < 0"), ["v"]).collect() == [(None,)]
    # values that differ in their last bits only need every pass
    close = [1 + i * 2.0**-52 for i in range(101)]
    near = spark.createDataFrame([(x,) for x in close], "v double")
    assert exact_medians(near, ["v"]).first()[0] == close[50]


def test_group_medians_count_rows_by_pattern(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 4)), None if rng.random() < 0.3 else float(rng.normal()), float(rng.integers(0, 5))) for _ in range(700)]
    df = spark.createDataFrame(rows, "g int, a double, b double").repartition(4)
    registry = Registry((Subgroup("one", "low", "g < 2"), Subgroup("one", "zero", "g = 0"), Subgroup("two", "none", "g > 9"), Subgroup("two", "some", "g >= 1")))
    got = {(r["attribute"], r["grp"]): (r["a"], r["b"]) for r in group_medians(df, ["a", "b"], registry).collect()}
    want = {("all", "all"): "true", ("one", "low"): "g < 2", ("one", "zero"): "g = 0", ("two", "some"): "g >= 1"}
    assert set(got) == set(want)
    for key, condition in want.items():
        assert got[key] == tuple(df.where(condition).agg(F.median("a"), F.median("b")).first())
    assert set(group_medians(df, ["a"], registry, ()).select("grp").first()) == {"all"}
    plan = group_medians(df, ["a"], registry)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Cartesian" not in plan


def test_imputation_uses_training_values_only(spark):
    train = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, e double")
    test = spark.createDataFrame([(None, 5.0), (100.0, None)], "a double, e double")
    assert [tuple(r) for r in impute(train, test, ["a", "e"]).collect()] == [(2.0, 5.0), (100.0, 0.0)]
    assert fit_fill_values(train, ["a"], "mean").first()[0] == 2.0
    assert fit_fill_values(train, ["a"], "approx_median").first()[0] in (1.0, 3.0)
    with pytest.raises(ValueError):
        fit_fill_values(train, ["a"], "mode")


def test_standardise_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    assert [tuple(r) for r in standardize(df, df, ["a", "c"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_assemble_rejects_nulls_and_range_check_keeps_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, -1.0)], "a double, b double")
    assert assemble(df.dropna(), ["a", "b"]).first()["features"].toArray().tolist() == [1.0, 2.0]
    with pytest.raises(Exception):
        assemble(df, ["a", "b"]).collect()
    assert outside_range(df, "b", low=0).count() == 1 and df.count() == 2
