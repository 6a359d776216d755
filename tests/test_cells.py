"""Scores and votes counted by equal rows, against the same rows one by one; cohorts whose joins are made once."""

import random

from pyspark.sql import functions as F

from cohortlens.catalog import selected
from cohortlens.functions import order_key
from cohortlens.operators.metrics import classification_metrics
from cohortlens.operators.split import SPLIT_SEED, stratified_folds
from cohortlens.operators.subgroups import ALL, Registry, Subgroup, with_membership
from cohortlens.plans import evaluation as E

REGISTRY = Registry((Subgroup("size", "big", "v > 3"), Subgroup("size", "odd", "v % 2 = 1"), Subgroup("none", "none", "v > 99")))


def _rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2, 3, 4, 5]), rng.randint(0, 1), int(rng.random() < 0.2), rng.randint(0, 9) / 10, rng.random()) for i in range(400)]
    rows += rows[:30] + [(None, 4, 1, 0, 0.5, 0.5)] * 3
    df = spark.createDataFrame(rows, "row_id long, v int, y1 int, y2 int, p__a double, p__b double")
    return df.withColumns({"yhat__a": F.when(F.col("p__a") > 0.5, 1).otherwise(0), "yhat__b": F.when(F.col("p__b") > 0.5, 1).otherwise(0),
                           "okey": order_key("row_id", SPLIT_SEED)})


def test_folds_of_cells_are_those_of_rows(spark):
    train = _rows(spark)
    keys = ["attribute", "grp", "outcome", "algorithm", "fold", "y", "p", "yhat"]
    cells = E.folded_cells(train, REGISTRY, ["y1", "y2"], ["a", "b"], {"population": 3, "subgroup": 2}, SPLIT_SEED)
    got = {tuple(r[k] for k in keys): r["n"] for r in cells.groupBy(*keys).agg(F.sum("n").alias("n")).collect()}
    long = E.by_outcome(with_membership(train, REGISTRY, whole=True), ["y1", "y2"])
    long = stratified_folds(long.withColumn("k", F.when(F.col("attribute") == ALL, 3).otherwise(2)), "y", "k", ["outcome", "attribute", "grp"], order="okey")
    long = E.by_model(long, ["a", "b"])
    assert got == {tuple(r[k] for k in keys): r["count"] for r in long.groupBy(*keys).count().collect()}
    one, two = ({(*r[:4],): tuple(round(x, 9) for x in r[5:]) for r in t.collect()} for t in (E.scope_cv_scores(cells, weight="n"), E.scope_cv_scores(long)))
    assert len(one) == 12 and repr(sorted(one.items())) == repr(sorted(two.items()))


def test_weights_count_rows(spark):
    rows = _rows(spark).select("v", F.col("y1").alias("y"), F.col("yhat__a").alias("yhat"))
    cells = rows.groupBy("v", "y", "yhat").agg(F.count(F.lit(1)).alias("n"))
    one, two = (sorted(map(repr, classification_metrics(d, ["v"], keep_counts=True, weight=w).collect())) for d, w in ((rows, None), (cells, "n")))
    assert one == two


def test_cohort_is_joined_once(spark, monkeypatch):
    """The split reads a stored cohort, not the joins below it."""
    seen, split = [], selected.split_train_test
    monkeypatch.setattr(selected.C, "scored_orders", lambda *_: _rows(spark).repartition(2).withColumn("row_id", F.coalesce("row_id", F.lit(0))))
    monkeypatch.setattr(selected, "split_train_test", lambda df: seen.append(df.inputFiles()) or split(df))
    selected.prepared(spark, "")
    assert seen[0]
