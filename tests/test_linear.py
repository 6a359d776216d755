import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortlens.operators import linear
from cohortlens.operators.cohort import CohortSpec, Outcome
from cohortlens.operators.linear import _advance, _State
from cohortlens.operators.models import ModelSettings
from cohortlens.operators.subgroups import Registry, Subgroup
from cohortlens.operators.training import Part
from cohortlens.plans import study as ST

SPEC = CohortSpec(
    row_id="row_id", numeric=("a", "b", "big"), categorical={"kind": "x"},
    outcomes={"y1": Outcome("o1", (1,)), "y2": Outcome("o2", (1,))}, carry=("kind", "side"))
REGISTRY = Registry((Subgroup("side", "left", "side = 'l'"), Subgroup("side", "right", "side = 'r'"), Subgroup("kind", "rare", "kind = 'z'")))


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        a, b, big = rng.normal(), rng.normal(2, 3), rng.uniform(0, 4e5)
        kind, side = "xyz"[int(rng.integers(0, 3))], None if rng.random() < 0.1 else "lr"[int(rng.random() < 0.3)]
        o1 = int(rng.random() < 1 / (1 + np.exp(-(a - 0.3 * b + big / 2e5 - 1))))
        o2 = int(rng.random() < (0.02 if kind == "z" else 0.4))
        rows.append((i, None if rng.random() < 0.15 else a, float("nan") if rng.random() < 0.1 else b, big, kind, side, o1, o2))
    df = spark.createDataFrame(rows, "row_id long, a double, b double, big double, kind string, side string, o1 int, o2 int").repartition(3)
    return ST.prepare(df, ST.StudySpec(SPEC, REGISTRY, algorithms=("log-reg",), folds_outer=3))


@pytest.fixture(scope="module")
def fits(study):
    parts = linear.study_parts(study.plan, study.scopes, study.outcomes, True, True)
    return ST._linear_parts(study, parts)


def training_rows(study, part):
    scope = next(s for s in study.scopes if s.key == (part.attribute, part.grp))
    rows = study.labelled(study.vectors(scope, "train"), part.outcome)
    column = lambda name, held=-1: study.plan.column(name, scope, part.outcome, held_out=held)
    if part.held_out >= 0:
        rows = rows.where(column("outer") != part.held_out)
    return rows if part.name == "final" else rows.where(column(part.name, part.held_out) != part.fold)


def objective(x, y, w):
    margin = np.column_stack([x, np.ones(len(x))]) @ w
    return float((np.logaddexp(0, margin) - y * margin).sum() + 0.5 * (w[:-1] ** 2).sum())


def test_every_part_of_a_study_is_fitted_once(study, fits):
    _, coefficients = fits
    # 4 scopes and 2 outcomes: final, 2 or 3 folds, halves of everything and of 3 outer parts, 3 outer folds
    assert len(coefficients) == 2 * (1 + 3 + 2 + 6 + 3) + 3 * 2 * (1 + 2 + 2 + 6 + 3)
    assert all(np.isfinite(w).all() for w in coefficients.values())


@pytest.mark.parametrize("part", [
    Part("all", "all", "y1", "final"), Part("all", "all", "y2", "cv", -1, 1), Part("side", "right", "y1", "inner", -1, 0),
    Part("side", "left", "y2", "inner", 2, 1), Part("kind", "rare", "y1", "outer", -1, 2)])
def test_fits_equal_single_ones(study, fits, part):
    rows = training_rows(study, part).select("y", vector_to_array("features").alias("x")).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    w = fits[1][part]
    # the gradient of the objective vanishes
    design = np.column_stack([x, np.ones(len(x))])
    gradient = design.T @ (1 / (1 + np.exp(-design @ w)) - y) + np.append(w[:-1], 0)
    assert np.abs(gradient / np.sqrt((design**2).sum(axis=0) + 1)).max() < 1e-5
    # Spark's own fit on features of one magnitude has the same coefficients; only the penalty's weight needs scaling
    spark = study.table.sparkSession
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    own = spark.createDataFrame([(float(v), (r / scale).tolist()) for v, r in zip(y, x, strict=True)], "y double, x array<double>")
    free = linear._State(np.zeros(len(w)), np.zeros(len(w)))
    scaled = np.column_stack([x / scale, np.ones(len(x))])
    low = np.tril_indices(len(w))
    for _ in range(60):
        p = 1 / (1 + np.exp(-scaled @ free.now))
        sums = np.concatenate([[(np.logaddexp(0, scaled @ free.now) - y * (scaled @ free.now)).sum()], (p - y) @ scaled,
                               (p * (1 - p)) @ (scaled[:, low[0]] * scaled[:, low[1]])])
        free = _advance(free, sums, len(w), 1.0)
        if free.done:
            break
    model = LogisticRegression(labelCol="y", maxIter=1000, tol=1e-14, regParam=1 / len(y), standardization=False).fit(
        own.select("y", array_to_vector("x").alias("features")))
    assert free.best == pytest.approx(np.append(model.coefficients.toArray(), model.intercept), abs=1e-6)
    assert objective(x, y, w) <= objective(x, y, np.zeros(len(w)))


def test_partitions_and_strips_do_not_matter(study, fits, monkeypatch):
    rows, coefficients = fits
    some = [p for p in coefficients if p.outcome == "y1" and p.name == "cv"]
    monkeypatch.setattr(linear, "STRIP", 37)
    again = linear.fit_together(rows.repartition(7), some, study.scopes, study.outcomes, study.plan, ST._feature_fill(study))
    for p in some:
        assert again[p] == pytest.approx(coefficients[p], rel=1e-6, abs=1e-9)


def test_rows_outside_and_of_one_class(study):
    rows = linear.numbered_rows(study.table.where("not is_test"), study.features, study.outcomes, study.plan, study.scopes).collect()
    sides = {r["row_id"]: r["side"] for r in study.table.collect()}
    per_scope = len(study.outcomes) * (2 + 1 + 3)
    at = {s.key: i * per_scope for i, s in enumerate(study.scopes)}
    for r in rows:
        inside = {key for key, i in at.items() if r["folds"][i] != linear.OUTSIDE}
        assert ("all", "all") in inside
        assert (("side", "left") in inside) == (sides[r["row_id"]] == "l") and (("side", "right") in inside) == (sides[r["row_id"]] == "r")


def test_scores_of_held_out_rows(study, fits):
    rows, coefficients = fits
    got = {(r["attribute"], r["grp"], r["outcome"], r["row_id"]): r for r in linear.held_out_scores(
        rows, coefficients, study.scopes, study.outcomes, study.plan, ST._feature_fill(study)).collect()}
    for scope in study.scopes:
        train = study.labelled(study.vectors(scope, "train"), "y1").withColumn("fold", study.plan.column("cv", scope, "y1"))
        for r in train.collect():
            mine = got[(*scope.key, "y1", r["row_id"])]
            w = coefficients[Part(*scope.key, "y1", "cv", -1, r["fold"])]
            margin = float(np.append(r["features"].toArray(), 1) @ w)
            assert mine["fold"] == r["fold"] and mine["y"] == r["y"] and mine["p"] == pytest.approx(1 / (1 + np.exp(-margin)))
            assert mine["yhat"] == int(mine["p"] > 0.5)


def test_study_uses_them(study, fits):
    ST.fit_linear(study)
    known = study.ready[("log-reg", Part("side", "left", "y1", "final"))]
    scope = study.scopes[1]
    scored = known.score(study.labelled(study.vectors(scope, "train"), "y1")).first()
    w = fits[1][Part("side", "left", "y1", "final")]
    assert scored["s__log-reg"] == pytest.approx(float(np.append(scored["features"].toArray(), 1) @ w))
    assert scored["p__log-reg"] == pytest.approx(1 / (1 + np.exp(-scored["s__log-reg"])))
    summary = ST.linear_cv_scores(study)
    assert summary.count() == 4 * 2 * 6 and summary.where(F.size("raw") == 3).count() == 2 * 6


def test_separable_rows_and_bad_steps_settle():
    x = np.array([[-2.0], [-1.0], [1.0], [2.0]])
    y = np.array([0.0, 0.0, 1.0, 1.0])
    design = np.column_stack([x, np.ones(4)])
    low = np.tril_indices(2)
    state = _State(np.array([60.0, -40.0]), np.zeros(2), 4 * np.log(2))
    for _ in range(100):
        margin = design @ state.now
        p = 1 / (1 + np.exp(-margin))
        state = _advance(state, np.concatenate([[(np.logaddexp(0, margin) - y * margin).sum()], (p - y) @ design,
                                                (p * (1 - p)) @ (design[:, low[0]] * design[:, low[1]])]), 2, 1.0)
        if state.done:
            break
    assert state.done and abs(state.best[1]) < 1e-6 and 1 < state.best[0] < 2


def test_settings_of_the_penalty(study):
    rows, _ = ST._linear_parts(study, [])
    part = [Part("all", "all", "y1", "final")]
    strong = linear.fit_together(rows, part, study.scopes, study.outcomes, study.plan, ST._feature_fill(study), ModelSettings(logistic_c=1e-4))
    weak = linear.fit_together(rows, part, study.scopes, study.outcomes, study.plan, ST._feature_fill(study), ModelSettings(logistic_c=1e4))
    assert np.abs(strong[part[0]][:2]).max() < np.abs(weak[part[0]][:2]).max()
