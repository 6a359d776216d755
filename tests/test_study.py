import math

import pytest
from pyspark.sql import functions as F

from cohortlens.operators.cohort import derive, feature_table, features_and_outcomes, fit_cohort_levels
from cohortlens.operators.models import ALGORITHMS, ModelSettings, algorithms, fit, score_all
from cohortlens.operators.training import plan_folds
from cohortlens.plans import cohorts as C
from cohortlens.plans.study import StudySpec, prepare, run_study
from cohortlens.sources import ResultStore

LIGHT = ModelSettings(tree_depth=3, logistic_iterations=20)


@pytest.fixture(scope="module")
def stays(spark):
    """Made-up stays with the columns of the hospital layout."""
    pick = lambda seed, values: F.element_at(
        F.array(*[F.lit(v) for v in values]), (F.floor(F.rand(seed) * len(values)) + 1).cast("int"))
    df = spark.range(0, 400, 1, 2).withColumnRenamed("id", "row_id")
    df = df.withColumns({
        "gender": pick(1, ["m", "f"]), "insurance": pick(2, ["self pay", "private", "medicare", "medicaid", "government"]),
        "ethnicity": pick(3, ["WHITE", "white - russian", "BLACK/AFRICAN AMERICAN", "ASIAN", "declined", "alaska native", "latino"]),
        "agegroup": pick(4, ["18-39", "40-49", "50-59", "60-69", "70-79", "80+"]),
        "age": F.when(F.rand(5) < 0.1, None).otherwise(40 + F.rand(6) * 50), "los-h(days)": F.rand(7) * 20 - 0.5,
    })
    flags = {c: (F.rand(20 + i) < 0.4).cast("int") for i, c in enumerate(C.STAY_NUMERIC[2:])}
    df = df.withColumns(flags)
    sick = 0.2 * F.col("shock?") + F.col("age") / 200
    return df.withColumn("discharge_location", F.when(F.rand(8) < sick - 0.2, "dead/expired").when(
        F.rand(9) < 0.6, "home").otherwise("snf")).cache()


def test_stay_features(spark, stays):
    df = derive(stays, C.STAY_SPEC)
    levels = fit_cohort_levels(df, C.STAY_SPEC)
    table, features = feature_table(df, C.STAY_SPEC, levels)
    assert len(features) == 16 + 5 + 1 + 4 + 5  # this sample has no polynesian level
    assert "gender_f" in features and "gender_m" not in features and "los_h_days" in features
    row = table.where("race = 'alaska-native/american-indian'").first()
    assert row["race_alaska_native_american_indian"] == 1 and row["race_white_caucasian_american"] == 0
    x, y = features_and_outcomes(table, features, ["y1", "y2"])
    assert x.columns == ["row_id", *features] and y.columns == ["row_id", "y1", "y2"]


def test_fold_plan_covers_every_row_once(spark, stays):
    spec = StudySpec(C.STAY_SPEC, C.STAY_REGISTRY, algorithms=("dt",), attributes=("sex",))
    study = prepare(stays, spec)
    train = study.table.where("not is_test")
    for scope in study.scopes:
        rows = scope.rows(train).withColumn("y", F.col("y1"))
        n = rows.count()
        for name in ("cv", "outer", "inner"):
            k = study.plan.k(name, scope)
            sizes = {r["f"]: r["count"] for r in rows.groupBy(study.plan.column(name, scope, "y1").alias("f")).count().collect()}
            assert sum(sizes.values()) == n and set(sizes) == set(range(k)) and max(sizes.values()) - min(sizes.values()) <= 1
            for f, size in sizes.items():
                assert sum(study.plan.count(name, scope, "y1", -1, f)) == size
        assert sum(study.plan.total(scope, "y1")) == n
    assert plan_folds(train, C.STAY_REGISTRY, ["y1"], study.plan.sizes, 13, ("sex",), nested=False).ends


def test_whole_study(spark, stays, tmp_path):
    spec = StudySpec(C.STAY_SPEC, C.STAY_REGISTRY, algorithms=("dt", "log-reg"), attributes=("sex",), settings=LIGHT,
                     folds_outer=2, parallel_fits=8)
    store = ResultStore(spark, str(tmp_path / "study"))
    out = run_study(stays, spec, store)
    p = out["predictions"].cache()
    test_rows = store.read("split", is_test="true").count()
    assert test_rows == math.ceil(0.33 * 400)
    per = p.where("attribute = 'all'").groupBy("outcome", "algorithm", "calibration").count().collect()
    assert len(per) == 2 * 2 * 3 and {r["count"] for r in per} == {test_rows}
    assert p.where(~F.col("p").between(0, 1)).count() == 0
    assert p.groupBy("attribute", "grp", "outcome", "algorithm", "calibration", "row_id").count().where("count > 1").count() == 0
    raw = {(r["attribute"], r["calibration"]): r["n"] for r in out["cv_scores"].groupBy("attribute", "calibration").agg(
        F.max(F.size("raw")).alias("n")).collect()}
    assert raw["all", "raw"] == 3 and raw["sex", "raw"] == 2 and raw["all", "isotonic"] == 2
    e = out["evaluation"]
    assert {r["strategy"] for r in e.select("strategy").distinct().collect()} == {
        "one_for_all", "one_per_group", "ensemble_on_all", "ensemble_on_group"}
    assert e.where("attribute = 'all' and strategy = 'one_for_all'").count() == 2 * 3
    # hand check of one cell: the shared model on women, from the stored predictions
    best = e.where("outcome = 'y2' and strategy = 'one_for_all' and calibration = 'raw' and grp = 'female'").first()
    options = [
        r["a"] for r in p.where("attribute = 'all' and outcome = 'y2' and calibration = 'raw' and gender = 'f'")
        .groupBy("algorithm").agg(F.avg((F.col("y") == F.col("yhat")).cast("int")).alias("a")).collect()]
    assert any(best["accuracy"] == pytest.approx(a) for a in options)
    assert out["strategies_by_group"].count() == 2 * 2 * 4
    assert out["ensemble_cv"].where("attribute = 'sex'").count() == 2 * 2 * 6
    bins = {(r["outcome"], r["algorithm"], r["calibration"]): r["n"] for r in out["reliability"].groupBy(
        "outcome", "algorithm", "calibration").agg(F.sum("n").alias("n")).collect()}
    assert len(bins) == 2 * 2 * 3 and set(bins.values()) == {test_rows}
    assert out["prevalence"].where("is_test and attribute = 'all'").first()["n"] == test_rows
    assert {r["report"] for r in out["chart_limits"].collect()} == {
        "calibration_overall", "calibration_by_group", "single_vs_ensembles", "strategies_by_group"}


def test_every_algorithm_scores_between_zero_and_one(spark, stays):
    tiny = ModelSettings(tree_depth=3, forest_trees=3, forest_depth=3, logistic_iterations=5, stump_rounds=2, hidden_units=4,
                         network_iterations=5, boosting_rounds=2, boosting_depth=2, svm_components=10, svm_iterations=5)
    study = prepare(stays, StudySpec(C.STAY_SPEC, C.STAY_REGISTRY, attributes=("sex",), calibrated_cv=False))
    scope = study.scopes[0]
    train = study.labelled(study.vectors(scope, "train"), "y2").cache()
    counts = study.plan.total(scope, "y2")
    fitted = [fit(a, train, counts, len(study.features), tiny) for a in algorithms()]
    assert [f.algorithm.name for f in fitted] == ["dt", "rf", "log-reg", "gb", "mlp", "svm", "xgb"] == list(ALGORITHMS)
    scored = score_all(fitted, train)
    bad = sum((F.when(~F.col(f"p__{m}").between(0, 1) | ~F.col(f"yhat__{m}").isin(0, 1), 1).otherwise(0) for m in ALGORITHMS), F.lit(0))
    assert scored.agg(F.sum(bad)).first()[0] == 0
    # the same seed gives the same model
    again = fit(algorithms(["dt"])[0], train, counts, len(study.features), tiny).score(train, "again")
    assert scored.select("row_id", "p__dt").join(again, "row_id").where("p__dt <> p__again").count() == 0
    # one class: no model, and its scores say so
    none = fit(algorithms(["dt"])[0], train.where("y = 1"), (0, 5), len(study.features), tiny).score(train)
    assert none.where(~F.isnan("p__dt")).count() == 0
    with pytest.raises(ValueError):
        algorithms(["knn"])
