import math

import pytest
from pyspark.sql import functions as F

from cohortlens.operators.selection import best_models, drop_repeats, runners_up, union_all
from cohortlens.operators.subgroups import Registry, Subgroup, any_of, membership_table, subgroup_rows, with_membership
from cohortlens.operators.votes import (
    collect_weights, ensemble_members, hard_vote, member_weights, predictions_long, predictions_wide, soft_score,
    soft_vote, vote_table,
)
from cohortlens.plans.reports import side_by_side
from cohortlens.sources import ResultStore, drop_matching, read_cohort

NAMES = ("dt", "rf", "log-reg", "gb", "mlp", "svm", "xgb")


def scores(spark, values, scope="s"):
    rows = [(scope, n, i, v, v) for i, (n, v) in enumerate(zip(NAMES, values))]
    return spark.createDataFrame(rows, "scope string, algorithm string, ordinal int, f1 double, accuracy double")


def test_ties_go_to_the_first_model(spark):
    assert best_models(scores(spark, [1.0] * 7), ["scope"]).first()["algorithm"] == "dt"
    got = runners_up(scores(spark, [1.0] * 7), ["scope"]).orderBy("model_rank").collect()
    assert [r["algorithm"] for r in got] == ["rf", "log-reg"]


def test_nan_means_never_win(spark):
    nan = math.nan
    assert best_models(scores(spark, [nan, 0.2, 0.4, nan, 0.4, 0.1, 0.0]), ["scope"]).first()["algorithm"] == "log-reg"
    assert best_models(scores(spark, [nan] * 7), ["scope"]).count() == 0
    with pytest.raises(ValueError):
        best_models(scores(spark, [0.1] * 7), ["scope"], "kappa")


def test_metric_differs_by_outcome(spark):
    df = spark.createDataFrame(
        [("y1", "dt", 0, 0.9, 0.1), ("y1", "rf", 1, 0.1, 0.9), ("y2", "dt", 0, 0.9, 0.1), ("y2", "rf", 1, 0.1, 0.9)],
        "outcome string, algorithm string, ordinal int, f1 double, accuracy double")
    got = best_models(df, ["outcome"], {"y1": "f1", "y2": "accuracy"}).collect()
    assert {r["outcome"]: r["algorithm"] for r in got} == {"y1": "dt", "y2": "rf"}


def test_votes_break_ties_towards_zero(spark):
    rows = [(1, 1, 0, 0.9, 0.1), (2, 1, 1, 0.6, 0.6), (3, 0, 0, 0.5, 0.5), (4, 0, 1, 0.2, 0.9)]
    df = spark.createDataFrame(rows, "id int, yhat__a int, yhat__b int, p__a double, p__b double")
    got = df.orderBy("id").select(
        hard_vote({"a": 1, "b": 1}).alias("even"), hard_vote({"a": 1, "b": 2}).alias("heavy"),
        soft_vote({"a": 1, "b": 1}).alias("soft"), soft_score({"a": 3, "b": 1}).alias("score")).collect()
    assert [r["even"] for r in got] == [0, 1, 0, 0]
    assert [r["heavy"] for r in got] == [0, 1, 0, 1]
    assert [r["soft"] for r in got] == [0, 1, 0, 1]
    assert got[0]["score"] == pytest.approx((3 * 0.9 + 0.1) / 4)
    # k identical members vote as the member does
    assert [r[0] for r in df.orderBy("id").select(hard_vote({"b": 5})).collect()] == [0, 1, 0, 1]


def test_members_accumulate_over_attributes(spark):
    base = spark.createDataFrame([("y1", "rf"), ("y1", "mlp")], "outcome string, algorithm string")
    won = spark.createDataFrame(
        [("y1", "sex", "male", "xgb"), ("y1", "sex", "female", "xgb"), ("y1", "race", "white", "rf")],
        "outcome string, attribute string, grp string, algorithm string")
    own = collect_weights(ensemble_members(base, won, ["sex", "race"]), NAMES)
    assert own == {("y1", "sex"): {"rf": 1, "mlp": 1, "xgb": 2}, ("y1", "race"): {"rf": 2, "mlp": 1}}
    kept = collect_weights(ensemble_members(base, won, ["sex", "race"], accumulate=True), NAMES)
    assert kept["y1", "race"] == {"rf": 2, "mlp": 1, "xgb": 2}
    assert member_weights(ensemble_members(base, won, ["sex"]), ["outcome", "ensemble"]).count() == 3


def test_vote_table_uses_the_weights_of_the_outcome(spark):
    df = spark.createDataFrame([(1, "y1", 1, 1, 0, 0.9, 0.1), (1, "y2", 0, 1, 0, 0.9, 0.1)],
                               "row_id int, outcome string, y int, yhat__a int, yhat__b int, p__a double, p__b double")
    got = vote_table(df, {("y1", "e"): {"a": 1}, ("y2", "e"): {"b": 1}}, ["row_id"]).collect()
    assert {r["outcome"]: r["yhat_hard"] for r in got} == {"y1": 1, "y2": 0}


def test_predictions_pivot_back_and_forth(spark):
    df = spark.createDataFrame([(1, 1, 0, 0.9, 0.1), (2, 0, 1, 0.2, 0.8)],
                               "row_id int, yhat__a int, yhat__b int, p__a double, p__b double")
    long = predictions_long(df, ["row_id"], ["a", "b"]).withColumn("calibration", F.lit("raw"))
    wide = predictions_wide(long, ["row_id"], names=["a__raw", "b__raw"])
    assert [tuple(r) for r in wide.orderBy("row_id").collect()] == [(1, 1, 0), (2, 0, 1)]


REGISTRY = Registry((
    Subgroup("size", "small", "v < 10"), Subgroup("size", "even", "v % 2 = 0"),
    Subgroup("kind", "letters", any_of("k = 'a'", "k = 'b'")), Subgroup("kind", "rare", "k = 'z'", enabled=False),
))


def test_membership_is_many_to_many(spark):
    df = spark.createDataFrame([(1, 4, "a"), (2, 11, "c"), (3, 12, None)], "row_id int, v int, k string")
    got = {(r["row_id"], r["attribute"], r["grp"]) for r in membership_table(df, REGISTRY).collect()}
    assert got == {(1, "size", "small"), (1, "size", "even"), (1, "kind", "letters"), (3, "size", "even")}
    assert with_membership(df, REGISTRY, whole=True).where("grp = 'all'").count() == 3
    assert subgroup_rows(df, REGISTRY.get("size", "even")).count() == 2
    assert [g.name for g in REGISTRY.active(["kind"], with_disabled=True)] == ["letters", "rare"]
    with pytest.raises(ValueError):
        REGISTRY.active(["age"])
    with pytest.raises(ValueError):
        Registry((Subgroup("a", "b", "true"), Subgroup("a", "b", "false")))


def test_repeats_keep_the_first(spark):
    a = spark.createDataFrame([(1, "all", 0.5), (2, "male", 0.4)], "part int, grp string, accuracy double")
    b = spark.createDataFrame([(3, "all", 0.5), (4, "all", 0.6)], "part int, grp string, accuracy double")
    got = drop_repeats(union_all([a, b]), "part").orderBy("part").collect()
    assert [(r["part"], r["grp"]) for r in got] == [(1, "all"), (2, "male"), (4, "all")]


def test_reports_meet_by_key(spark):
    rows = [("y1", "g", "raw", 0.0225, 0.5, 0.5, 0.5), ("y1", "g", "isotonic", 0.5, 0.5, 0.5, 0.125)]
    df = spark.createDataFrame(rows, "outcome string, grp string, calibration string, accuracy double, f1 double, precision double, recall double")
    got = {r["metric"]: (r["raw"], r["isotonic"]) for r in side_by_side(df, ["outcome", "grp"], "calibration", ["raw", "isotonic"]).collect()}
    assert got == {"accuracy": (2.2, 50.0), "f1": (50.0, 50.0), "precision": (50.0, 50.0), "recall": (50.0, 12.5)}


def test_store_prunes_and_keeps_other_partitions(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        store.read("evaluation")
    df = spark.createDataFrame([("y1", None, None, 1.0), ("y1", "sex", "007", 2.0), ("y2", "sex", "f", 3.0)],
                               "outcome string, attribute string, grp string, mean double")
    back = store.write("cv_scores", df)
    assert {(r["attribute"], r["grp"]) for r in back.collect()} == {("all", "all"), ("sex", "007"), ("sex", "f")}
    store.write("cv_scores", df.where("grp = 'f'").withColumn("mean", F.lit(9.0)))
    one = store.read("cv_scores", outcome="y2")
    assert one.first()["mean"] == 9.0 and store.read("cv_scores").count() == 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(outcome" in plan
    with pytest.raises(ValueError):
        store.path("plots")


def test_csv_cohort_without_export_columns(spark, tmp_path):
    path = tmp_path / "cohort.csv"
    path.write_text(",Unnamed: 0,age,sex\n0,0,41,f\n1,1,,m\n")
    df = read_cohort(spark, str(path))
    assert df.columns == ["age", "sex"] and df.count() == 2
    assert drop_matching(df, "^s").columns == ["age"]
    typed = read_cohort(spark, str(path), "age double, sex string")
    assert dict(typed.dtypes)["age"] == "double"
