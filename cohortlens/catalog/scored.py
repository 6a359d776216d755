"""Queries on scored rows: metrics, AUC, reliability, cross-validation, calibration, votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import sql as S
from cohortlens.catalog.base import query
from cohortlens.operators.calibration import apply_calibrators, apply_isotonic, fit_calibrators, fit_isotonic, fit_sigmoid
from cohortlens.operators.cohort import derive
from cohortlens.operators.metrics import (
    CV_METRICS, EVALUATION_METRICS, cv_summary, fold_scores, prevalence, reliability_curve, roc_auc, scorer_metrics,
    subgroup_metrics as metrics_by_group,
)
from cohortlens.operators.selection import union_all
from cohortlens.operators.split import inner_folds, split_train_test, stratified_folds
from cohortlens.operators.subgroups import with_membership
from cohortlens.operators.votes import hard_vote, predictions_long, predictions_wide, soft_score, soft_vote
from cohortlens.plans import cohorts as C
from cohortlens.plans import evaluation as E
from cohortlens.plans.evaluation import long_by_outcome
from cohortlens.sources import read_split

KEEP = ["row_id", *C.ORDER_ATTRIBUTES]
TAGS = ["outcome", "algorithm"]
SCOPE = ["attribute", "grp"]


def rounded(df, columns, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


def scored_long(spark, folder):
    """One row per order, outcome and scorer."""
    return long_by_outcome(C.scored_orders(spark, folder), ["y1", "y2"], C.SCORERS, KEEP)


_MEMBERS = f"{S.SCORED}, {S.unpivot('scored')}, {S.member('long')}"


@query("q_subgroup_metrics", f"""
WITH {_MEMBERS}, c AS (SELECT outcome, algorithm, attribute, grp, {S.COUNTS} FROM member GROUP BY ALL)
SELECT outcome, algorithm, attribute, grp, n, tp, fp, fn, tn, {S.FOUR} FROM c""")
def subgroup_metrics(spark, folder):
    out = scorer_metrics(C.scored_orders(spark, folder), C.ORDER_REGISTRY, ["y1", "y2"], C.SCORERS, keep_counts=True)
    return rounded(out, EVALUATION_METRICS)


@query("q_document_metrics", f"""
WITH cohort AS (SELECT d.doc_id AS row_id, lang, source, toxic AS y, CASE WHEN length(text) < 500 THEN 1 ELSE 0 END AS yhat,
    CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 2500 THEN 'mid' ELSE 'long' END AS length_band
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
{S.member('cohort', groups=[('lang', 'english', "lang = 'en'"), ('lang', 'non_english', "lang IN ('de', 'es', 'fr')"),
  ('source', 'src0', "source = 'src0'"), ('source', 'src1_or_src2', "source IN ('src1', 'src2')"),
  ('length', 'short', "length_band = 'short'"), ('length', 'long', "length_band = 'long'")])},
c AS (SELECT attribute, grp, {S.COUNTS} FROM member GROUP BY ALL)
SELECT attribute, grp, n, tp, fp, fn, tn, {S.FOUR} FROM c""")
def document_metrics(spark, folder):
    df = derive(C.documents_cohort(spark, folder), C.DOCUMENT_SPEC)
    df = df.select("row_id", "lang", "source", "length_band", F.col("y1").alias("y"),
                   F.when(F.col("n_chars") < 500, 1).otherwise(0).alias("yhat"))
    return rounded(metrics_by_group(df, C.DOCUMENT_REGISTRY, [], keep_counts=True), EVALUATION_METRICS)


_MACRO = ("balanced_accuracy", "precision_macro", "recall_macro")


@query("q_macro_balanced", f"""
WITH {_MEMBERS}, c AS (SELECT outcome, algorithm, attribute, grp, {S.COUNTS} FROM member GROUP BY ALL)
SELECT outcome, algorithm, attribute, grp, {', '.join(f'round({S.METRIC[m]}, 6) AS {m}' for m in _MACRO)} FROM c""")
def macro_balanced(spark, folder):
    return rounded(scorer_metrics(C.scored_orders(spark, folder), C.ORDER_REGISTRY, ["y1", "y2"], C.SCORERS, _MACRO), _MACRO)


@query("q_auc", f"""
WITH {_MEMBERS}, {S.auc('member', 'a', 'outcome, algorithm, attribute, grp')}
SELECT outcome, algorithm, attribute, grp, round(roc_auc, 6) AS roc_auc FROM a""")
def auc(spark, folder):
    rows = with_membership(scored_long(spark, folder), C.ORDER_REGISTRY, whole=True)
    return rounded(roc_auc(rows, [*TAGS, *SCOPE]), ["roc_auc"])


@query("q_prevalence", f"""
WITH {S.SPLIT}, {S.member('split')}
SELECT is_test, attribute, grp, count(*) AS n, sum(y1)::BIGINT AS y1_n, round_even(avg(y1) * 100, 0) AS y1_pct,
  sum(y2)::BIGINT AS y2_n, round_even(avg(y2) * 100, 0) AS y2_pct FROM member GROUP BY ALL""")
def prevalences(spark, folder):
    df = split_train_test(derive(C.orders_cohort(spark, folder), C.ORDER_SPEC))
    return prevalence(with_membership(df, C.ORDER_REGISTRY, whole=True), ["is_test", *SCOPE], ["y1", "y2"])


@query("q_reliability", f"""
WITH {_MEMBERS}
SELECT outcome, algorithm, attribute, grp, CAST(floor(p / ((1.0::DOUBLE + 1e-8::DOUBLE) / 10)) AS INTEGER) AS bin, count(*) AS n,
  round(avg(p), 9) AS mean_score, round(avg(y), 9) AS positive_share FROM member GROUP BY ALL""")
def reliability(spark, folder):
    rows = with_membership(scored_long(spark, folder), C.ORDER_REGISTRY, whole=True)
    return rounded(reliability_curve(rows, [*TAGS, *SCOPE]), ["mean_score", "positive_share"], 9)


# --- cross-validation on fixed scorers ------------------------------------

_TRAIN_LONG = f"{S.SCORED}, train AS (SELECT * FROM scored WHERE NOT is_test), {S.unpivot('train')}"


def train_long(spark, folder):
    train = read_split(split_train_test(C.scored_orders(spark, folder)), "train")
    return long_by_outcome(train, ["y1", "y2"], C.SCORERS, KEEP)


def _wide_folds(summary, keys, k):
    value = lambda i: F.round(F.get("raw", F.lit(i)), 6)
    return summary.select(*keys, "metric", *[value(i).alias(f"fold_{i}") for i in range(k)], F.round("mean", 6).alias("mean"))


def _cv_sql(source: str, keys: str, k: int) -> str:
    cols = ", ".join(f"round(max(CASE WHEN fold = {i} THEN value END), 6) AS fold_{i}" for i in range(k))
    parts = " UNION ALL ".join(f"SELECT {keys}, fold, '{m}' AS metric, {m} AS value FROM {source}_f" for m in CV_METRICS)
    return f"SELECT {keys}, metric, {cols}, round(avg(value), 6) AS mean FROM ({parts}) GROUP BY {keys}, metric"


@query("q_cv_scores", f"""
WITH {_TRAIN_LONG}, {S.folds('long', 'f', 3, 'outcome, algorithm')}, {S.cv_means('f', 'outcome, algorithm')}
{_cv_sql('cv', 'outcome, algorithm', 3)}""")
def cv_scores(spark, folder):
    train = E.by_outcome(read_split(split_train_test(C.scored_orders(spark, folder)), "train"), ["y1", "y2"])
    rows = E.by_model(stratified_folds(train, "y", 3, ["outcome"]), C.SCORERS)
    return _wide_folds(cv_summary(fold_scores(rows, TAGS), TAGS), TAGS, 3)


_DOC_FOLDS = """
WITH long AS (SELECT d.doc_id AS row_id, md5(concat_ws('-', d.doc_id, '13')) AS okey, source AS grp, toxic AS y,
    least(length(text) / 20000.0::DOUBLE, 1.0::DOUBLE) AS p, CASE WHEN length(text) > 10000 THEN 1 ELSE 0 END AS yhat
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


@query("q_cv_nan_fold", f"""
{_DOC_FOLDS}, {S.folds('long', 'f', 5, 'grp')}, {S.cv_means('f', 'grp')}
SELECT grp, CAST((SELECT count(*) FROM cv_f x WHERE x.grp = cv.grp AND isnan(accuracy)) AS BIGINT) AS nan_folds,
  CAST(isnan(accuracy) AS INTEGER) AS accuracy_is_nan, CAST(isnan(roc_auc) AS INTEGER) AS auc_is_nan,
  round(CASE WHEN isnan(accuracy) THEN -1 ELSE accuracy END, 6) AS accuracy,
  round(CASE WHEN isnan(roc_auc) THEN -1 ELSE roc_auc END, 6) AS roc_auc FROM cv""")
def cv_nan_fold(spark, folder):
    """Small sources have folds without a toxic document: their scores and means are NaN."""
    df = C.documents_cohort(spark, folder).select(
        "row_id", F.col("source").alias("grp"), F.col("toxic").alias("y"),
        F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("p"),
        F.when(F.col("n_chars") > 10000, 1).otherwise(0).alias("yhat"))
    per_fold = fold_scores(stratified_folds(df, "y", 5, ["grp"]), ["grp"])
    out = per_fold.groupBy("grp").agg(
        F.count_if(F.isnan("accuracy")).alias("nan_folds"), F.avg("accuracy").alias("accuracy"),
        F.avg("roc_auc").alias("roc_auc"))
    flag = lambda c: F.isnan(c).cast("int")
    shown = lambda c: F.round(F.when(F.isnan(c), -1.0).otherwise(F.col(c)), 6).alias(c)
    return out.select("grp", "nan_folds", flag("accuracy").alias("accuracy_is_nan"), flag("roc_auc").alias("auc_is_nan"),
                      shown("accuracy"), shown("roc_auc"))


# --- calibration ----------------------------------------------------------

@query("q_isotonic", f"""
WITH {_TRAIN_LONG}, one AS (SELECT * FROM long WHERE algorithm = 'a'), {S.isotonic('one', 'iso', 'outcome')}
SELECT outcome, s AS score, round(v, 6) AS value FROM iso""")
def isotonic(spark, folder):
    """Isotonic fit of scorer a on the training part, read off at every score that occurs."""
    rows = train_long(spark, folder).where("algorithm = 'a'")
    fitted = fit_isotonic(rows, ["outcome"], score="p")
    scores = rows.select("outcome", F.col("p").alias("score")).distinct()
    return rounded(apply_isotonic(scores, fitted, ["outcome"], out="value"), ["value"])


@query("q_calibrated_mean", f"""
WITH {S.SCORED}, {S.unpivot('scored')}, one AS (SELECT * FROM long WHERE algorithm = 'a'),
train AS (SELECT * FROM one WHERE NOT is_test), test AS (SELECT * FROM one WHERE is_test),
{S.folds('train', 'fit', 2, 'outcome')}, {S.isotonic('fit', 'iso', 'outcome, fold')},
both_inner AS (SELECT test.*, f.fold FROM test, (SELECT 0 AS fold UNION ALL SELECT 1) f),
{S.apply_isotonic('iso', 'both_inner', 'cal', 'outcome, fold')}
SELECT row_id, outcome, round(avg(v), 6) AS p, CASE WHEN avg(v) > 0.5 THEN 1 ELSE 0 END AS yhat
FROM both_inner JOIN cal USING (outcome, fold, p) GROUP BY row_id, outcome""")
def calibrated(spark, folder):
    """Two calibrators, one per half of the training part; test rows get the mean of both."""
    df = split_train_test(C.scored_orders(spark, folder))
    fit_rows = inner_folds(
        long_by_outcome(read_split(df, "train"), ["y1", "y2"], ["a"], ["row_id"]), "y", ["outcome"])
    test = long_by_outcome(read_split(df, "test"), ["y1", "y2"], ["a"], ["row_id"]).select(
        "row_id", "outcome", F.col("p").alias("s0"), F.col("p").alias("s1"))
    fitted = fit_calibrators(fit_rows.withColumnRenamed("p", "score"), ["outcome"], ["isotonic"])
    scored = apply_calibrators(test, fitted, ["outcome"], ["s0", "s1"], ["isotonic"])
    return rounded(scored.select("row_id", "outcome", "p", "yhat"), ["p"])


@query("q_sigmoid", f"""
WITH RECURSIVE {_TRAIN_LONG}, {S.folds('long', 'fit', 2, 'outcome, algorithm')}, {S.sigmoid('fit', 'sig', 'outcome, algorithm, fold')}
SELECT outcome, algorithm, fold AS "inner", round(a, 6) AS a, round(b, 6) AS b FROM sig""")
def sigmoids(spark, folder):
    """Platt's sigmoid of every scorer and outcome on either half of the training part, all fitted together."""
    fit_rows = inner_folds(train_long(spark, folder), "y", TAGS)
    return rounded(fit_sigmoid(fit_rows, [*TAGS, "inner"], score="p"), ["a", "b"])


@query("q_three_calibrations", f"""
WITH RECURSIVE {S.SCORED}, {S.unpivot('scored')}, one AS (SELECT * FROM long WHERE algorithm = 'b'),
train AS (SELECT * FROM one WHERE NOT is_test), test AS (SELECT * FROM one WHERE is_test),
{S.folds('train', 'fit', 2, 'outcome')}, {S.isotonic('fit', 'iso', 'outcome, fold')}, {S.sigmoid('fit', 'sig', 'outcome, fold')},
both_inner AS (SELECT test.*, f.fold FROM test, (SELECT 0 AS fold UNION ALL SELECT 1) f),
{S.apply_isotonic('iso', 'both_inner', 'cal', 'outcome, fold')},
variants AS (
  SELECT row_id, outcome, 'raw' AS calibration, y, p FROM test
  UNION ALL SELECT row_id, outcome, 'isotonic', y, avg(v) FROM both_inner JOIN cal USING (outcome, fold, p) GROUP BY row_id, outcome, y
  UNION ALL SELECT row_id, outcome, 'sigmoid', y, avg(1.0::DOUBLE / (1.0::DOUBLE + exp(a * p + b)))
            FROM both_inner JOIN sig USING (outcome, fold) GROUP BY row_id, outcome, y)
SELECT row_id, outcome, calibration, y, round(p, 6) AS p, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS yhat FROM variants""")
def three_calibrations(spark, folder):
    """Raw, sigmoid and isotonic predictions of scorer b on every test row and outcome."""
    df = split_train_test(C.scored_orders(spark, folder))
    fit_rows = inner_folds(
        long_by_outcome(read_split(df, "train"), ["y1", "y2"], ["b"], ["row_id"]), "y", ["outcome"])
    test = long_by_outcome(read_split(df, "test"), ["y1", "y2"], ["b"], ["row_id"])
    fitted = fit_calibrators(fit_rows.withColumnRenamed("p", "score"), ["outcome"])
    pairs = test.select("row_id", "outcome", "y", F.col("p").alias("s0"), F.col("p").alias("s1"))
    again = apply_calibrators(pairs, fitted, ["outcome"], ["s0", "s1"])
    raw = test.withColumn("calibration", F.lit("raw"))
    columns = ["row_id", "outcome", "calibration", "y", "p", "yhat"]
    return rounded(union_all([raw.select(*columns), again.select(*columns)]), ["p"])


# --- votes ----------------------------------------------------------------

_EVEN = {"a": 1, "b": 2, "c": 1}


@query("q_hard_vote", f"""
WITH {S.SCORED} SELECT row_id, CASE WHEN (yhat_a + 2 * yhat_b + yhat_c) * 2 > 4 THEN 1 ELSE 0 END AS yhat_hard FROM scored""")
def vote_hard(spark, folder):
    """Four votes, so that ties occur; a tie gives 0."""
    return C.scored_orders(spark, folder).select("row_id", hard_vote(_EVEN).alias("yhat_hard"))


@query("q_soft_vote", f"""
WITH {S.SCORED}, v AS (SELECT row_id, (p_a * 1.0::DOUBLE + p_b * 2.0::DOUBLE + p_c * 1.0::DOUBLE) / 4.0::DOUBLE AS p_soft FROM scored)
SELECT row_id, round(p_soft, 6) AS p_soft, CASE WHEN p_soft > 0.5 THEN 1 ELSE 0 END AS yhat_soft FROM v""")
def vote_soft(spark, folder):
    return C.scored_orders(spark, folder).select(
        "row_id", F.round(soft_score(_EVEN), 6).alias("p_soft"), soft_vote(_EVEN).alias("yhat_soft"))


@query("q_vote_cv", f"""
WITH {S.SCORED}, train AS (SELECT * FROM scored WHERE NOT is_test),
long AS (SELECT row_id, okey, 'y1' AS outcome, y1 AS y, (p_a * 1.0::DOUBLE + p_b * 2.0::DOUBLE + p_c * 1.0::DOUBLE) / 4.0::DOUBLE AS p FROM train
  UNION ALL SELECT row_id, okey, 'y2', y2, (p_a * 1.0::DOUBLE + p_b * 2.0::DOUBLE + p_c * 1.0::DOUBLE) / 4.0::DOUBLE FROM train),
voted AS (SELECT *, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS yhat FROM long),
{S.folds('voted', 'f', 5, 'outcome')}, {S.cv_means('f', 'outcome')}
{_cv_sql('cv', 'outcome', 5)}""")
def vote_cv(spark, folder):
    """Five-fold scores of the soft vote."""
    train = read_split(split_train_test(C.scored_orders(spark, folder)), "train")
    voted = train.withColumns({"p__vote": soft_score(_EVEN), "yhat__vote": soft_vote(_EVEN)})
    rows = long_by_outcome(voted, ["y1", "y2"], ["vote"], ["row_id"])
    rows = stratified_folds(rows, "y", 5, ["outcome"])
    return _wide_folds(cv_summary(fold_scores(rows, ["outcome"]), ["outcome"]), ["outcome"], 5)


@query("q_predictions_wide", f"""
WITH {S.SCORED} SELECT row_id, y1 AS true_y, yhat_a AS a__raw, yhat_b AS b__raw, yhat_c AS c__raw FROM scored""")
def wide(spark, folder):
    """Long predictions back to one column per model."""
    df = C.scored_orders(spark, folder)
    long = predictions_long(df, ["row_id", "y1"], C.SCORERS).withColumn("calibration", F.lit("raw"))
    names = [f"{m}__raw" for m in C.SCORERS]
    return predictions_wide(long, ["row_id", "y1"], names=names).withColumnRenamed("y1", "true_y")


__all__ = ["KEEP", "SCOPE", "TAGS", "rounded", "scored_long", "train_long", "union_all"]
