"""The whole study from one call: split, train, calibrate, combine, evaluate, compare."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.encode import slug
from cohortlens.functions.order import order_key
from cohortlens.operators.calibration import apply_calibrators, fit_calibrators
from cohortlens.operators.cohort import CohortSpec, derive, feature_table, fit_cohort_levels
from cohortlens.operators import linear
from cohortlens.operators.metrics import cv_summary, cv_wide, fold_scores, prevalence, reliability_curve
from cohortlens.operators.models import Algorithm, Fitted, ModelSettings, algorithms, score_col
from cohortlens.operators.orderstats import group_medians
from cohortlens.operators.selection import SELECTION_METRIC, runners_up, union_all
from cohortlens.operators.split import SPLIT_SEED, TEST_SHARE, split_train_test
from cohortlens.operators.subgroups import ALL, Registry, with_membership
from cohortlens.operators.training import (
    FoldPlan, Scope, cached, plan_folds, scopes_of, train_scope, vectors, vote_cv_scores,
)
from cohortlens.operators.votes import collect_weights, ensemble_members, p_col, soft_score, vote_table, yhat_col
from cohortlens.plans import evaluation as E
from cohortlens.plans import reports as R
from cohortlens.session import materialize, new_folder, settled
from cohortlens.sources import ResultStore, read_split

MODEL_KEYS = ["attribute", "grp", "outcome", "algorithm", "ordinal"]


@dataclass(frozen=True)
class StudySpec:
    """Everything that decides a study's results.

    ``accumulate`` lets an ensemble keep the winners of the attributes before its own.
    ``refit=False`` lets a group's winner vote as fitted on the group, instead of
    fitted on everyone. ``members_from`` takes all group winners from one outcome.
    ``base_members`` names the members every ensemble starts with, instead of the runners-up.
    """

    cohort: CohortSpec
    registry: Registry
    algorithms: tuple[str, ...] | None = None
    attributes: tuple[str, ...] | None = None
    settings: ModelSettings = field(default_factory=ModelSettings)
    metric: Mapping[str, str] = field(default_factory=lambda: dict(SELECTION_METRIC))
    test_share: float = TEST_SHARE
    seed: int = SPLIT_SEED
    folds_population: int = 3
    folds_subgroup: int = 2
    folds_outer: int = 5
    calibrated_cv: bool = True
    ensemble_cv: bool = True
    accumulate: bool = False
    refit: bool = True
    members_from: str | None = None
    base_members: tuple[str, ...] | None = None
    parallel_fits: int = 4

    def attribute_names(self) -> list[str]:
        return list(self.attributes or self.registry.attributes())


@dataclass
class Study:
    """A prepared cohort with its fold plan; the starting point of all training."""

    spec: StudySpec
    store: ResultStore
    table: DataFrame
    features: list[str]
    numeric: list[str]
    fill: dict[tuple[str, str], Mapping[str, float]]
    plan: FoldPlan
    scopes: list[Scope]
    algos: list[Algorithm]
    #: scores of this run only, so that a repeated study does not add to an earlier one's
    work: str
    final: dict[tuple, Fitted] = field(default_factory=dict)
    ready: dict[tuple, Fitted] = field(default_factory=dict)

    @property
    def outcomes(self) -> list[str]:
        return list(self.spec.cohort.outcomes)

    @property
    def carry(self) -> list[str]:
        return list(self.spec.cohort.carry)

    def vectors(self, scope: Scope, part: str) -> DataFrame:
        keep = ["row_id", *self.outcomes, *self.carry]
        rows = scope.rows(read_split(self.table, part))
        return vectors(rows, self.features, self.numeric, self.fill[scope.key], keep)

    def labelled(self, df: DataFrame, outcome: str, keep: Sequence[str] = ()) -> DataFrame:
        return df.select("row_id", F.col(outcome).alias("y"), *keep, "okey", "features")


def prepare(df: DataFrame, spec: StudySpec, store: ResultStore | None = None) -> Study:
    """Derive features and labels, split, and find fill values and fold ends of every scope."""
    store = store or ResultStore(df.sparkSession, new_folder(df.sparkSession, "study"))
    # levels and split read the cohort several times: its joins are made once
    derived = materialize(derive(df, spec.cohort), "cohort")
    table, features = feature_table(derived, spec.cohort, fit_cohort_levels(derived, spec.cohort))
    table = split_train_test(table, test_share=spec.test_share, seed=spec.seed)
    table = store.write("split", table.withColumn("okey", order_key("row_id", spec.seed)))
    train = read_split(table, "train")
    numeric = [slug(c) for c in spec.cohort.numeric]
    rows = group_medians(train, numeric, spec.registry, spec.attributes).collect()
    sizes = {"population": spec.folds_population, "subgroup": spec.folds_subgroup, "outer": spec.folds_outer, "inner": 2}
    plan = plan_folds(train, spec.registry, list(spec.cohort.outcomes), sizes, spec.seed, spec.attributes, spec.calibrated_cv)
    fill = {(r["attribute"], r["grp"]): {c: r[c] for c in numeric} for r in rows}
    # a group without training rows has nothing to train on
    scopes = [s for s in scopes_of(spec.registry, spec.attributes) if s.key in fill]
    work = f"{store.root.rstrip('/')}/work/{uuid.uuid4().hex[:12]}"
    return Study(spec, store, table, features, numeric, fill, plan, scopes, algorithms(spec.algorithms), work)


def _append(study: Study, name: str, df: DataFrame | None) -> None:
    if df is not None:
        df.write.mode("append").partitionBy("attribute", "grp", "outcome").parquet(f"{study.work}/{name}")


def _work(study: Study, name: str) -> DataFrame:
    df = study.store.spark.read.parquet(f"{study.work}/{name}")
    return df.withColumns({c: F.col(c).cast("string") for c in ("attribute", "grp", "outcome")})


def _feature_fill(study: Study) -> dict[tuple[str, str], list[float]]:
    """Value of every feature that stands for a missing one: the scope's median, 0 for indicators and empty columns."""
    value = lambda fill, c: 0.0 if fill.get(c) is None else float(fill[c])
    return {key: [value(fill, c) for c in study.features] for key, fill in study.fill.items()}


def _linear_parts(study: Study, parts: Sequence[linear.Part]) -> tuple[DataFrame, dict]:
    """Training rows with their folds, and coefficients of all parts."""
    rows = linear.stored_rows(read_split(study.table, "train"), study.features, study.outcomes, study.plan, study.scopes)
    return rows, linear.fit_together(rows, parts, study.scopes, study.outcomes, study.plan, _feature_fill(study), study.spec.settings)


def fit_linear(study: Study) -> None:
    """All logistic regressions of the study at once; they learn from all rows, whatever ``max_fit_rows`` says."""
    spec = study.spec
    if any(a.name == linear.NAME for a in study.algos):
        parts = linear.study_parts(study.plan, study.scopes, study.outcomes, spec.calibrated_cv, spec.ensemble_cv)
        study.ready.update(linear.fitted_models(_linear_parts(study, parts)[1]))


def linear_coefficients(study: Study, names: Sequence[str]) -> dict[linear.Part, Sequence[float]]:
    """Coefficients, the intercept last, of the named kinds of parts (``final``, ``cv``, ``inner``, ``outer``) in all scopes."""
    parts = linear.study_parts(study.plan, study.scopes, study.outcomes, study.spec.calibrated_cv, study.spec.ensemble_cv)
    return _linear_parts(study, [p for p in parts if p.name in names])[1]


def linear_cv_scores(study: Study) -> DataFrame:
    """Cross-validated scores of logistic regression in every scope and outcome: one job a Newton step, one to score."""
    parts = [p for p in linear.study_parts(study.plan, study.scopes, study.outcomes, False, False) if p.name == "cv"]
    rows, coefficients = _linear_parts(study, parts)
    scored = linear.held_out_scores(rows, coefficients, study.scopes, study.outcomes, study.plan, _feature_fill(study))
    keys = ["attribute", "grp", "outcome"]
    return cv_summary(fold_scores(scored, keys), keys)


def train_all(study: Study) -> None:
    """Train every scope and outcome and store the scores. Vectors of one scope are cached at a time."""
    spec = study.spec
    fit_linear(study)
    with ThreadPoolExecutor(spec.parallel_fits) as pool:
        for scope in study.scopes:
            train = cached(study.vectors(scope, "train"))
            test = study.vectors(scope, "test")
            try:
                for outcome in study.outcomes:
                    got = train_scope(
                        scope, outcome, study.labelled(train, outcome), study.labelled(test, outcome, study.carry),
                        study.plan, study.algos, spec.settings, len(study.features), pool, spec.calibrated_cv, study.carry,
                        study.ready,
                    )
                    for name, df in (("cv", got.cv), ("halves", got.calibration_fit),
                                     ("outer", got.calibration_apply), ("test", got.test)):
                        _append(study, name, df)
                    study.final.update({(*scope.key, outcome, m): f for m, f in got.final.items()})
            finally:
                train.unpersist()


def _half_pairs(df: DataFrame, algos: Sequence[Algorithm], keep: Sequence[str]) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(a.name).alias("algorithm"), F.lit(a.ordinal).alias("ordinal"),
                 F.col(f"h0__{a.name}").alias("s0"), F.col(f"h1__{a.name}").alias("s1")) for a in algos
    ])
    return df.withColumn("_e", F.explode(entries)).select(*keep, "_e.*")


def calibrators(study: Study) -> DataFrame:
    """Sigmoid and isotonic fits of every model and training part, from two jobs."""
    halves = _work(study, "halves")
    entries = F.array(*[
        F.struct(F.lit(a.name).alias("algorithm"), F.lit(a.ordinal).alias("ordinal"), F.col(score_col(a.name)).alias("score"))
        for a in study.algos
    ])
    rows = halves.withColumn("_e", F.explode(entries)).select(
        "attribute", "grp", "outcome", "held_out", "inner", "y", "_e.*")
    return fit_calibrators(rows, [*MODEL_KEYS, "held_out"])


def _named_models(df: DataFrame, algos: Sequence[Algorithm]) -> DataFrame:
    ordinal = F.element_at(F.create_map(*[x for a in algos for x in (F.lit(a.name), F.lit(a.ordinal))]), F.col("algorithm"))
    return E.by_model(df, [a.name for a in algos]).withColumn("ordinal", ordinal)


def cv_scores(study: Study, fitted: DataFrame) -> DataFrame:
    """Scores per model and calibration: ``..., calibration, metric, raw, mean``."""
    raw = _named_models(_work(study, "cv"), study.algos).withColumn("calibration", F.lit("raw"))
    keys = [*MODEL_KEYS, "calibration"]
    columns = [*keys, "fold", "y", "p", "yhat"]
    parts = [raw.select(*columns)]
    if study.spec.calibrated_cv:
        pairs = _half_pairs(_work(study, "outer"), study.algos, ["attribute", "grp", "outcome", "row_id", "held_out", "y"])
        again = apply_calibrators(pairs, fitted, [*MODEL_KEYS, "held_out"], ["s0", "s1"])
        parts.append(again.withColumnRenamed("held_out", "fold").select(*columns))
    return cv_summary(fold_scores(union_all(parts), keys), keys)


def predictions(study: Study, fitted: DataFrame) -> DataFrame:
    """Test predictions, long: raw, sigmoid and isotonic of every model and scope."""
    test = _work(study, "test")
    rows = ["row_id", "y", *study.carry]
    raw = _named_models(test, study.algos).withColumn("calibration", F.lit("raw"))
    pairs = _half_pairs(test, study.algos, ["attribute", "grp", "outcome", *rows])
    again = apply_calibrators(pairs, fitted.where("held_out = -1").drop("held_out"), MODEL_KEYS, ["s0", "s1"])
    columns = [*MODEL_KEYS, "calibration", *rows, "p", "yhat"]
    return union_all([raw.select(*columns), again.select(*columns)])


def choose(study: Study, scores: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Best per scope, best on everyone, and the runners-up on everyone. All small."""
    raw = scores.where(F.col("calibration") == "raw")
    wide = settled(cv_wide(raw, MODEL_KEYS))
    best = E.winners(wide, study.spec.metric)
    overall = wide.where(F.col("attribute") == ALL)
    if study.spec.base_members:
        named = [a.name for a in algorithms(study.spec.base_members)]
        base = overall.where(F.col("algorithm").isin(named)).select("outcome", "algorithm")
    else:
        base = runners_up(overall, ["outcome", "attribute", "grp"], study.spec.metric).select("outcome", "algorithm")
    return best.where(F.col("attribute") != ALL), best.where(F.col("attribute") == ALL), base


def _members_on_all(study: Study, by_group: DataFrame, base: DataFrame) -> DataFrame:
    chosen = by_group
    if study.spec.members_from:
        pinned = by_group.where(F.col("outcome") == study.spec.members_from).drop("outcome")
        entries = F.explode(F.array(*[F.lit(o) for o in study.outcomes]))
        chosen = pinned.withColumn("outcome", entries)
    return ensemble_members(base, chosen, study.spec.attribute_names(), study.spec.accumulate)


def specialist_votes(study: Study, members: DataFrame) -> DataFrame:
    """Votes on everyone where each group's winner is the model fitted on that group."""
    rows = members.groupBy("outcome", "ensemble", "algorithm", "origin").count().collect()
    scope = study.scopes[0]
    test = study.vectors(scope, "test")
    parts = []
    for outcome in study.outcomes:
        weights: dict[tuple[str, str], dict[str, int]] = {}
        df = study.labelled(test, outcome, study.carry).withColumn("outcome", F.lit(outcome))
        done = set()
        for r in (r for r in rows if r["outcome"] == outcome):
            where = (ALL, ALL) if r["origin"] == "base" else tuple(r["origin"].split("/", 1))
            name = "__".join([*where, r["algorithm"]])
            weights.setdefault((outcome, r["ensemble"]), {})[name] = r["count"]
            if name not in done:
                df = study.final[(*where, outcome, r["algorithm"])].score(df, name)
                done.add(name)
        parts.append(vote_table(df, weights, ["row_id", *study.carry]))
    return union_all(parts)


def _vote_cv(study: Study, weights: Mapping[tuple[str, str], Mapping[str, int]], scopes: Sequence[Scope]) -> DataFrame | None:
    """Soft-vote CV. Fits only the algorithms that are members."""
    if not study.spec.ensemble_cv:
        return None
    with ThreadPoolExecutor(study.spec.parallel_fits) as pool:
        for scope in scopes:
            train = cached(study.vectors(scope, "train"))
            try:
                for outcome in study.outcomes:
                    mine = {k: w for k, w in weights.items() if k[0] == outcome}
                    used = [a for a in study.algos if any(a.name in w for w in mine.values())]
                    rows = vote_cv_scores(scope, outcome, study.labelled(train, outcome), study.plan, used,
                                          study.spec.settings, len(study.features), pool, study.ready)
                    entries = F.array(*[
                        F.struct(F.lit(e).alias("ensemble"), soft_score(w).alias("p")) for (_, e), w in mine.items()
                    ])
                    voted = rows.withColumn("_e", F.explode(entries)).select(
                        "attribute", "grp", "outcome", "row_id", "fold", "y", "_e.*")
                    _append(study, "vote_cv", voted.withColumn(
                        "yhat", F.when((F.col("p") > 0.5) & ~F.isnan("p"), 1).otherwise(0)))
            finally:
                train.unpersist()
    keys = ["attribute", "grp", "outcome", "ensemble"]
    return cv_summary(fold_scores(_work(study, "vote_cv"), keys), keys)


def run_study(df: DataFrame, spec: StudySpec, store: ResultStore | None = None) -> dict[str, DataFrame]:
    """Run all phases and return the stored result tables by name."""
    study = prepare(df, spec, store)
    store = study.store
    train_all(study)
    fitted = calibrators(study)
    scores = store.write("cv_scores", cv_scores(study, fitted))
    predicted = store.write("predictions", predictions(study, fitted))

    by_group, overall, base = choose(study, scores)
    members = _members_on_all(study, by_group, base)
    order = [a.name for a in study.algos]
    on_all = collect_weights(members, order)
    with_best = base.unionByName(overall.select("outcome", "algorithm")).withColumn("ensemble", F.lit("best_and_runners_up"))
    on_group = collect_weights(with_best, order)

    test = _work(study, "test")
    everyone = F.col("attribute") == ALL
    rows = ["row_id", *study.carry]
    if spec.refit:
        votes_all = vote_table(test.where(everyone), on_all, rows)
    else:
        votes_all = specialist_votes(study, members)
    votes_all = votes_all.withColumns({"attribute": F.lit(ALL), "grp": F.lit(ALL)})
    votes_group = vote_table(test.where(~everyone), on_group, [*rows, "attribute", "grp"])
    votes = store.write("ensemble_predictions", union_all([votes_all, votes_group]))
    vote_scores = [
        s for s in (_vote_cv(study, on_all, study.scopes[:1]), _vote_cv(study, on_group, study.scopes[1:]))
        if s is not None
    ][-1:]  # both append to one table; the last read holds all scopes
    out = {"cv_scores": scores, "predictions": predicted, "ensemble_predictions": votes}
    if vote_scores:
        out["ensemble_cv"] = store.write("ensemble_cv", vote_scores[0])

    groups = spec.registry
    shared = predicted.where(everyone).drop("attribute", "grp")
    results = E.evaluation_table([
        E.one_for_all(shared, overall, _restricted(groups, spec)),
        E.one_per_group(predicted.where(~everyone), by_group),
        E.ensemble_on_all(votes.where(everyone).drop("attribute", "grp"), _restricted(groups, spec)),
        E.ensemble_on_group(votes.where(~everyone)),
    ])
    out["evaluation"] = store.write("evaluation", results)
    out.update(reports(out["evaluation"], spec.attribute_names()))
    # NaN scores, of models that saw one class, belong to no bin
    out["reliability"] = reliability_curve(
        predicted.where(everyone & ~F.isnan("p")), ["outcome", "algorithm", "calibration"])
    out["prevalence"] = prevalence(
        with_membership(study.table, groups, whole=True, attributes=spec.attributes), ["is_test", "attribute", "grp"], study.outcomes)
    return out


def _restricted(registry: Registry, spec: StudySpec) -> Registry:
    return Registry(tuple(registry.active(spec.attributes)))


def reports(evaluation: DataFrame, attributes: Sequence[str]) -> dict[str, DataFrame]:
    tables = {
        "calibration_overall": R.calibration_overall(evaluation, ("raw", "sigmoid", "isotonic")),
        "calibration_by_group": R.calibration_by_group(evaluation, ("raw", "sigmoid", "isotonic")),
        "single_vs_ensembles": R.single_vs_ensembles(evaluation, attributes),
        "strategies_by_group": R.strategies_by_group(evaluation),
    }
    fixed = {"outcome", "attribute", "grp", "metric"}
    tables["chart_limits"] = union_all([
        R.chart_limits(t, ["outcome", "metric"], [c for c in t.columns if c not in fixed]).withColumn("report", F.lit(name))
        for name, t in tables.items()
    ])
    return tables


__all__ = ["Study", "StudySpec", "p_col", "prepare", "run_study", "yhat_col"]
