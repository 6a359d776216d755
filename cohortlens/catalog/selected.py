"""Queries on model choice, ensembles, evaluation and reports, with the three fixed scorers as models.

The scorers need no training, so a whole study (cross-validation, choice per
group, ensembles, four strategies, comparison tables) can be stated in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import sql as S
from cohortlens.catalog.base import query
from cohortlens.catalog.scored import rounded
from cohortlens.operators.calibration import apply_calibrators, fit_calibrators
from cohortlens.operators.metrics import EVALUATION_METRICS, highest
from cohortlens.operators.selection import SELECTION_METRIC, best_models, ranked_models, runners_up, union_all
from cohortlens.functions import order_key
from cohortlens.operators.split import SPLIT_SEED, split_train_test, stratified_folds
from cohortlens.operators.subgroups import ALL, with_membership
from cohortlens.operators.votes import collect_weights, ensemble_members, member_weights, vote_table, yhat_col
from cohortlens.plans import cohorts as C
from cohortlens.plans import evaluation as E
from cohortlens.plans import reports as R
from cohortlens.session import materialize, new_folder, settled
from cohortlens.sources import ResultStore, read_split

OUTCOMES = ["y1", "y2"]
SCOPES = ["outcome", "attribute", "grp"]
ATTRIBUTES = list(C.ORDER_ATTRIBUTES)

# --- CTE chain ------------------------------------------------------------

_CV = f"""{S.SCORED}, train AS (SELECT * FROM scored WHERE NOT is_test),
{S.unpivot('train', 'tlong')}, {S.member('tlong', 'tm', whole=False)}, tw AS (SELECT *, 'all' AS attribute, 'all' AS grp FROM tlong),
{S.folds('tw', 'fw', 3, 'attribute, grp, outcome, algorithm')}, {S.folds('tm', 'fm', 2, 'attribute, grp, outcome, algorithm')},
folded AS (SELECT * FROM fw UNION ALL BY NAME SELECT * FROM fm),
{S.cv_means('folded', 'attribute, grp, outcome, algorithm, ordinal')},
deciding AS (SELECT *, CASE outcome WHEN 'y1' THEN CASE WHEN isnan(f1) THEN NULL ELSE f1 END
    ELSE CASE WHEN isnan(accuracy) THEN NULL ELSE accuracy END END AS deciding_value FROM cv),
ranked AS (SELECT *, row_number() OVER (PARTITION BY outcome, attribute, grp
    ORDER BY deciding_value DESC NULLS LAST, ordinal) AS model_rank FROM deciding),
best AS (SELECT * FROM ranked WHERE model_rank = 1 AND deciding_value IS NOT NULL)"""

_ATTR_NO = "CASE {0} WHEN 'segment' THEN 1 WHEN 'region' THEN 2 WHEN 'priority' THEN 3 WHEN 'band' THEN 4 END"


def _members_sql(accumulate: bool) -> str:
    op = "<=" if accumulate else "="
    return f"""
base AS (SELECT outcome, algorithm FROM ranked WHERE attribute = 'all' AND model_rank IN (2, 3)),
attrs AS (SELECT * FROM (VALUES ('segment', 1), ('region', 2), ('priority', 3), ('band', 4)) t(ensemble, no)),
members AS (SELECT outcome, ensemble, algorithm FROM base, attrs
  UNION ALL SELECT outcome, ensemble, algorithm FROM best JOIN attrs ON {_ATTR_NO.format('attribute')} {op} no
  WHERE attribute <> 'all'),
weights AS (SELECT outcome, ensemble, algorithm, count(*) AS weight FROM members GROUP BY ALL)"""


_TEST = f"test AS (SELECT * FROM scored WHERE is_test), {S.unpivot('test', 'xlong')}"

_VOTES = f"""{_members_sql(False)}, {_TEST},
votes AS (SELECT row_id, segment, region, priority, band, x.outcome, ensemble, y,
    CASE WHEN sum(weight * yhat) * 2 > sum(weight) THEN 1 ELSE 0 END AS yhat
  FROM xlong x JOIN weights w ON x.outcome = w.outcome AND x.algorithm = w.algorithm
  GROUP BY row_id, segment, region, priority, band, x.outcome, ensemble, y),
group_members AS (SELECT outcome, algorithm FROM base UNION ALL SELECT outcome, algorithm FROM best WHERE attribute = 'all'),
{S.member('xlong', 'xm', whole=False)},
group_votes AS (SELECT row_id, attribute, grp, x.outcome, y,
    CASE WHEN sum(yhat) * 2 > count(*) THEN 1 ELSE 0 END AS yhat
  FROM xm x JOIN group_members g ON x.outcome = g.outcome AND x.algorithm = g.algorithm GROUP BY ALL)"""

_EVAL = f"""{_CV}, {_VOTES},
shared_train AS (SELECT t.* FROM tlong t JOIN best b ON b.attribute = 'all' AND b.outcome = t.outcome AND b.algorithm = t.algorithm),
{S.folds('shared_train', 'fit', 2, 'outcome')}, {S.isotonic('fit', 'iso', 'outcome, fold')},
shared_test AS (SELECT x.* FROM xlong x JOIN best b ON b.attribute = 'all' AND b.outcome = x.outcome AND b.algorithm = x.algorithm),
both_inner AS (SELECT x.*, f.fold FROM shared_test x, (SELECT 0 AS fold UNION ALL SELECT 1) f),
{S.apply_isotonic('iso', 'both_inner', 'cal', 'outcome, fold')},
recalibrated AS (SELECT row_id, segment, region, priority, band, outcome, y, CASE WHEN avg(v) > 0.5 THEN 1 ELSE 0 END AS yhat
  FROM both_inner JOIN cal USING (outcome, fold, p) GROUP BY ALL),
shared AS (SELECT row_id, segment, region, priority, band, outcome, y, yhat, 'raw' AS calibration FROM shared_test
  UNION ALL BY NAME SELECT *, 'isotonic' AS calibration FROM recalibrated),
{S.member('shared', 'shared_m')}, {S.member('votes', 'votes_m')},
rows_all AS (
  SELECT outcome, 'one_for_all' AS strategy, calibration, NULL AS ensemble, attribute, grp, y, yhat FROM shared_m
  UNION ALL SELECT x.outcome, 'one_per_group', 'raw', NULL, x.attribute, x.grp, y, yhat FROM xm x
    JOIN best b ON b.outcome = x.outcome AND b.attribute = x.attribute AND b.grp = x.grp AND b.algorithm = x.algorithm
  UNION ALL SELECT outcome, 'ensemble_on_all', 'raw', ensemble, attribute, grp, y, yhat FROM votes_m
    WHERE attribute = 'all' OR attribute = ensemble
  UNION ALL SELECT outcome, 'ensemble_on_group', 'raw', NULL, attribute, grp, y, yhat FROM group_votes),
counted AS (SELECT outcome, strategy, calibration, ensemble, attribute, grp, {S.COUNTS} FROM rows_all GROUP BY ALL),
evaluation AS (SELECT outcome, strategy, calibration, ensemble, attribute, grp,
  {', '.join(f'{S.METRIC[m]} AS {m}' for m in EVALUATION_METRICS)} FROM counted)"""


# --- the same study in Spark ----------------------------------------------

def prepared(spark, folder):
    """The scored cohort with its split, written once: everything below reads it several times."""
    # the split reads the cohort several times: its joins are made once
    df = split_train_test(materialize(C.scored_orders(spark, folder), "cohort")).withColumn("okey", order_key("row_id", SPLIT_SEED))
    return materialize(df, "scored", ("is_test",))


def scope_scores(study):
    """CV scores of every scope: three folds on everyone, two in subgroups. A few dozen rows."""
    sizes = {"population": 3, "subgroup": 2}
    cells = E.folded_cells(read_split(study, "train"), C.ORDER_REGISTRY, OUTCOMES, C.SCORERS, sizes, SPLIT_SEED)
    return settled(E.scope_cv_scores(cells, weight="n"))


def test_cells(study):
    """Test rows that agree in attributes, labels and predicted classes, as one row with their count ``n``."""
    columns = [*ATTRIBUTES, *OUTCOMES, *[yhat_col(m) for m in C.SCORERS]]
    return settled(read_split(study, "test").groupBy(*columns).agg(F.count(F.lit(1)).alias("n")), "cells")


def cells_by_group(cells):
    long = E.by_model(E.by_outcome(cells, OUTCOMES), C.SCORERS, scores=False)
    return with_membership(long, C.ORDER_REGISTRY).withColumn("calibration", F.lit("raw"))


def group_best(scores):
    return E.winners(scores).where(F.col("attribute") != ALL)


def overall_best(scores):
    return E.winners(scores).where(F.col("attribute") == ALL)


def base_members(scores):
    return runners_up(scores.where(F.col("attribute") == ALL), SCOPES, SELECTION_METRIC).select("outcome", "algorithm")


def votes_on_all(cells, scores):
    members = ensemble_members(base_members(scores), group_best(scores), ATTRIBUTES)
    return vote_table(E.by_outcome(cells, OUTCOMES), collect_weights(members, C.SCORERS), [*ATTRIBUTES, "n"], soft=False)


def votes_on_groups(cells, scores):
    members = base_members(scores).unionByName(overall_best(scores).select("outcome", "algorithm"))
    weights = collect_weights(members.withColumn("ensemble", F.lit("best_and_runners_up")), C.SCORERS)
    votes = vote_table(E.by_outcome(cells, OUTCOMES), weights, [*ATTRIBUTES, "n"], soft=False)
    return with_membership(votes, C.ORDER_REGISTRY)


def shared_predictions(study, scores):
    """Raw and isotonic test predictions of the best model on everyone; equal ones are one row with their count ``n``."""
    best = overall_best(scores).select("outcome", "algorithm")
    long = lambda part, keep: E.long_by_outcome(read_split(study, part), OUTCOMES, C.SCORERS, keep).join(
        F.broadcast(best), ["outcome", "algorithm"])
    rows = [*ATTRIBUTES, "outcome", "algorithm", "y"]
    test = settled(long("test", ATTRIBUTES).groupBy(*rows, "p", "yhat").agg(F.count(F.lit(1)).alias("n")), "shared")
    train = settled(long("train", ["row_id", "okey"]), "shared-train")
    halves = stratified_folds(train, "y", 2, ["outcome"], fold="inner", order="okey").withColumnRenamed("p", "score")
    fitted = fit_calibrators(halves, ["outcome"], ["isotonic"])
    doubled = test.withColumns({"s0": F.col("p"), "s1": F.col("p")}).drop("p", "yhat")
    again = apply_calibrators(doubled, fitted, ["outcome"], ["s0", "s1"], ["isotonic"])
    return union_all([
        test.select(*rows, "n", "p", "yhat").withColumn("calibration", F.lit("raw")),
        again.select(*rows, "n", "p", "yhat", "calibration"),
    ])


def evaluation(spark, folder):
    study = prepared(spark, folder)
    scores = scope_scores(study)
    cells = test_cells(study)
    return E.evaluation_table([
        E.one_for_all(shared_predictions(study, scores), overall_best(scores), C.ORDER_REGISTRY, weight="n"),
        E.one_per_group(cells_by_group(cells), group_best(scores), weight="n"),
        E.ensemble_on_all(votes_on_all(cells, scores), C.ORDER_REGISTRY, weight="n"),
        E.ensemble_on_group(votes_on_groups(cells, scores), weight="n"),
    ])


# --- queries --------------------------------------------------------------

@query("q_best_model", f"""
WITH {_CV} SELECT outcome, attribute, grp, trim(algorithm) AS algorithm, round(deciding_value, 6) AS deciding_value FROM best""")
def best_model(spark, folder):
    out = E.winners(scope_scores(prepared(spark, folder)))
    return rounded(out.select(*SCOPES, "algorithm", "deciding_value"), ["deciding_value"])


@query("q_best_by_metric", f"""
WITH {_CV}, m AS (SELECT 'f1' AS metric, *, f1 AS v FROM cv UNION ALL SELECT 'balanced_accuracy', *, balanced_accuracy FROM cv
  UNION ALL SELECT 'accuracy', *, accuracy FROM cv),
r AS (SELECT *, row_number() OVER (PARTITION BY metric, outcome, attribute, grp ORDER BY CASE WHEN isnan(v) THEN NULL ELSE v END
  DESC NULLS LAST, ordinal) AS rn FROM m)
SELECT metric, outcome, attribute, grp, algorithm, round(v, 6) AS deciding_value FROM r WHERE rn = 1 AND NOT isnan(v)""")
def best_by_metric(spark, folder):
    scores = scope_scores(prepared(spark, folder))
    parts = [
        best_models(scores, SCOPES, m).select(F.lit(m).alias("metric"), *SCOPES, "algorithm", "deciding_value")
        for m in ("f1", "balanced_accuracy", "accuracy")
    ]
    return rounded(union_all(parts), ["deciding_value"])


@query("q_runner_up", f"""
WITH {_CV} SELECT outcome, attribute, grp, algorithm, model_rank FROM ranked WHERE model_rank IN (2, 3)""")
def runner_up(spark, folder):
    scores = scope_scores(prepared(spark, folder))
    return runners_up(scores, SCOPES, SELECTION_METRIC).select(*SCOPES, "algorithm", "model_rank")


@query("q_model_ranks", f"""
WITH {_CV} SELECT outcome, attribute, grp, algorithm, model_rank, round(deciding_value, 6) AS deciding_value FROM ranked""")
def model_ranks(spark, folder):
    ranked = ranked_models(scope_scores(prepared(spark, folder)), SCOPES, SELECTION_METRIC)
    return rounded(ranked.select(*SCOPES, "algorithm", "model_rank", "deciding_value"), ["deciding_value"])


@query("q_members", f"WITH {_CV}, {_members_sql(True)} SELECT outcome, ensemble, algorithm, weight FROM weights")
def members(spark, folder):
    """Members accumulate over attributes: an ensemble also holds the winners of the attributes before it."""
    scores = scope_scores(prepared(spark, folder))
    found = ensemble_members(base_members(scores), group_best(scores), ATTRIBUTES, accumulate=True)
    return member_weights(found, ["outcome", "ensemble"])


def _formatted(prefix: str = "") -> str:
    return ", ".join(f"round({m}, 6) AS {m}" for m in EVALUATION_METRICS)


@query("q_evaluation", f"WITH {_EVAL} SELECT outcome, strategy, calibration, ensemble, attribute, grp, {_formatted()} FROM evaluation")
def full_evaluation(spark, folder):
    return rounded(evaluation(spark, folder), EVALUATION_METRICS)


@query("q_best_per_group", f"""
WITH {_EVAL} SELECT outcome, attribute, grp, {_formatted()} FROM evaluation WHERE strategy = 'one_per_group'""")
def best_per_group(spark, folder):
    study = prepared(spark, folder)
    scores = scope_scores(study)
    out = E.one_per_group(cells_by_group(test_cells(study)), group_best(scores), weight="n")
    return rounded(out.select("outcome", "attribute", "grp", *EVALUATION_METRICS), EVALUATION_METRICS)


@query("q_ensemble_eval", f"""
WITH {_EVAL} SELECT outcome, strategy, ensemble, attribute, grp, {_formatted()} FROM evaluation WHERE strategy LIKE 'ensemble%'""")
def ensemble_eval(spark, folder):
    study = prepared(spark, folder)
    scores = scope_scores(study)
    cells = test_cells(study)
    out = union_all([
        E.ensemble_on_all(votes_on_all(cells, scores), C.ORDER_REGISTRY, weight="n"),
        E.ensemble_on_group(votes_on_groups(cells, scores), weight="n"),
    ])
    return rounded(out.select("outcome", "strategy", "ensemble", "attribute", "grp", *EVALUATION_METRICS), EVALUATION_METRICS)


@query("q_max_metric", f"""
WITH {_EVAL} SELECT outcome, strategy, round(max(greatest(accuracy, f1, precision, recall)), 6) AS highest FROM evaluation GROUP BY ALL""")
def max_metric(spark, folder):
    return rounded(highest(evaluation(spark, folder), ["outcome", "strategy"]), ["highest"])


@query("q_union_dedupe", f"""
WITH {_EVAL}, rows4 AS (SELECT outcome, attribute, grp, CASE WHEN strategy = 'one_for_all' THEN 1 ELSE 2 END AS part, accuracy FROM evaluation
  WHERE strategy IN ('one_for_all', 'one_per_group') AND calibration = 'raw'),
repeated AS (SELECT * FROM rows4 UNION ALL SELECT outcome, attribute, grp, part + 2, accuracy FROM rows4 WHERE attribute = 'all')
SELECT outcome, attribute, grp, round(accuracy, 6) AS accuracy, min(part) AS part FROM repeated GROUP BY ALL""")
def union_dedupe(spark, folder):
    """The whole-population row is reported once per attribute; repeats go, the first stays."""
    from cohortlens.operators.selection import drop_repeats

    rows = evaluation(spark, folder).where(F.col("strategy").isin("one_for_all", "one_per_group") & (F.col("calibration") == "raw"))
    rows = rounded(rows.select("outcome", "attribute", "grp", "accuracy",
                               F.when(F.col("strategy") == "one_for_all", 1).otherwise(2).alias("part")), ["accuracy"])
    rows = settled(rows)
    again = rows.where(F.col("attribute") == ALL).withColumn("part", F.col("part") + 2)
    return drop_repeats(union_all([rows, again]), "part")


def _pct(source: str, keys: str, variant: str, variants: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {keys}, {variant} AS variant, '{m}' AS metric, CAST(format('{{:.1f}}', {m} * 100) AS DOUBLE) AS pct FROM {source}"
        for m in EVALUATION_METRICS)
    cols = ", ".join(f"max(CASE WHEN variant = '{v}' THEN pct END) AS {v}" for v in variants)
    return f"SELECT {keys}, metric, {cols} FROM ({parts}) GROUP BY {keys}, metric"


@query("q_cal_vs_uncal", f"""
WITH {_EVAL}, r AS (SELECT * FROM evaluation WHERE strategy = 'one_for_all' AND attribute = 'all')
{_pct('r', 'outcome', 'calibration', ['raw', 'isotonic'])}""")
def cal_vs_uncal(spark, folder):
    return R.calibration_overall(evaluation(spark, folder))


@query("q_cal_by_group", f"""
WITH {_EVAL}, r AS (SELECT * FROM evaluation WHERE strategy = 'one_for_all' AND attribute <> 'all')
{_pct('r', 'outcome, attribute, grp', 'calibration', ['raw', 'isotonic'])}""")
def cal_by_group(spark, folder):
    return R.calibration_by_group(evaluation(spark, folder))


_VARIANT = "CASE WHEN strategy = 'one_for_all' THEN 'single_model' ELSE 'ensemble_by_' || ensemble END"


@query("q_single_vs_ensembles", f"""
WITH {_EVAL}, r AS (SELECT * FROM evaluation WHERE strategy IN ('one_for_all', 'ensemble_on_all') AND attribute = 'all' AND calibration = 'raw')
{_pct('r', 'outcome', _VARIANT, ['single_model', *[f'ensemble_by_{a}' for a in ATTRIBUTES]])}""")
def single_vs_ensembles(spark, folder):
    return R.single_vs_ensembles(evaluation(spark, folder), ATTRIBUTES)


@query("q_four_strategies", f"""
WITH {_EVAL}, r AS (SELECT * FROM evaluation WHERE attribute <> 'all' AND calibration = 'raw')
{_pct('r', 'outcome, attribute, grp', 'strategy', list(E.STRATEGIES))}""")
def four_strategies(spark, folder):
    return R.strategies_by_group(evaluation(spark, folder))


@query("q_result_store", f"""
WITH {_EVAL} SELECT attribute, grp, strategy, calibration, ensemble, {_formatted()} FROM evaluation WHERE outcome = 'y1'""")
def result_store(spark, folder):
    """Write the evaluation table, then read one outcome back through its partition."""
    store = ResultStore(spark, new_folder(spark, "evaluation"))
    store.write("evaluation", evaluation(spark, folder))
    return rounded(store.read("evaluation", outcome="y1").drop("outcome"), EVALUATION_METRICS)
