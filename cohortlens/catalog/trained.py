"""Queries that train models. Checked by invariants in the tests, not by SQL."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.catalog import sql as S
from cohortlens.catalog.base import query
from cohortlens.operators import linear
from cohortlens.operators.cohort import CohortSpec, derive, feature_table, fit_cohort_levels
from cohortlens.operators.features import assemble, impute
from cohortlens.operators.metrics import EVALUATION_METRICS, roc_auc, subgroup_metrics
from cohortlens.operators.models import ALGORITHMS, ModelSettings, algorithms, fit, score_all
from cohortlens.operators.split import split_train_test
from cohortlens.operators.subgroups import with_membership
from cohortlens.operators.training import cached
from cohortlens.plans import cohorts as C
from cohortlens.plans import study as ST
from cohortlens.plans.evaluation import by_model
from cohortlens.session import local_table, materialize
from cohortlens.sources import read_split

#: models keep their usual settings and are fitted on a seeded sample of at most about so many rows; all rows are scored
ORDER_SETTINGS = ModelSettings(max_fit_rows=3000)


def _orders(spark, folder, attributes=("segment",), **options):
    spec = ST.StudySpec(C.ORDER_SPEC, C.ORDER_REGISTRY, attributes=attributes, settings=ORDER_SETTINGS,
                        parallel_fits=8, **options)
    return ST.prepare(C.orders_cohort(spark, folder), spec)


def _order_vectors(spark, folder, outcome):
    """Imputed, assembled train and test orders, and the class counts of the training part."""
    df = materialize(derive(C.orders_cohort(spark, folder), C.ORDER_SPEC), "cohort")
    table, features = feature_table(df, C.ORDER_SPEC, fit_cohort_levels(df, C.ORDER_SPEC))
    table = materialize(split_train_test(table), "orders", ("is_test",))
    table = impute(read_split(table, "train"), table, list(C.ORDER_SPEC.numeric))
    rows = assemble(table, features).select(
        "row_id", F.col(outcome).alias("y"), "is_test", *C.ORDER_ATTRIBUTES, "features")
    train = cached(read_split(rows, "train"))
    counts = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    return train, read_split(rows, "test"), (counts.get(0, 0), counts.get(1, 0)), len(features)


def _single(name: str):
    def run(spark, folder):
        """Fit on the training part, then score every test row and evaluate everyone and each subgroup."""
        train, test, counts, n_features = _order_vectors(spark, folder, "y1")
        model = fit(algorithms([name])[0], train, counts, n_features, ORDER_SETTINGS)
        scored = by_model(model.score(test).drop("features"), [name])
        rows = with_membership(scored, C.ORDER_REGISTRY, whole=True)
        keys = ["algorithm", "attribute", "grp"]
        counts = subgroup_metrics(scored, C.ORDER_REGISTRY, ["algorithm"], keep_counts=True)
        return counts.join(roc_auc(rows, keys), keys)

    return run


for _name in ALGORITHMS:
    query(f"m_{_name.replace('-', '_')}")(_single(_name))


@query("m_probability")
def probability(spark, folder):
    """Class and positive-class probability of every test order, two models side by side."""
    train, test, counts, n_features = _order_vectors(spark, folder, "y2")
    algos = algorithms(["dt", "log-reg"])
    fitted = [fit(a, train, counts, n_features, ORDER_SETTINGS) for a in algos]
    return by_model(score_all(fitted, test), [a.name for a in algos]).select("row_id", "algorithm", "y", "p", "yhat")


@query("m_platt")
def platt(spark, folder):
    """Sigmoid and isotonic recalibration of a logistic regression on held-out halves, on all test orders."""
    study = _orders(spark, folder, attributes=(), algorithms=("log-reg",), calibrated_cv=False)
    ST.train_all(study)
    return ST.predictions(study, ST.calibrators(study)).select("outcome", "algorithm", "calibration", "row_id", "y", "p", "yhat")


@query("m_cv")
def cross_validation(spark, folder):
    """Three-fold CV on everyone, two-fold in all subgroups, both outcomes: raw fold scores and means of six metrics."""
    return ST.linear_cv_scores(_orders(spark, folder, attributes=None, algorithms=("log-reg",), calibrated_cv=False))


@query("m_calibrated_cv")
def calibrated_cross_validation(spark, folder):
    """Cross-validation of recalibrated models: outer folds scored by calibrators fitted inside each training part."""
    study = _orders(spark, folder, attributes=(), algorithms=("log-reg",))
    ST.train_all(study)
    return ST.cv_scores(study, ST.calibrators(study))


_TWO = CohortSpec(row_id="row_id", numeric=("disc", "qty"), categorical={}, outcomes=C.ORDER_SPEC.outcomes, carry=C.ORDER_ATTRIBUTES)

_TWO_ROWS = f"""
train AS (SELECT * FROM split WHERE NOT is_test), {S.member('train')},
filled AS (SELECT m.row_id, m.okey, m.attribute, m.grp, m.y1, m.y2, coalesce(m.disc, f.disc) AS x1, coalesce(m.qty, f.qty) AS x2
  FROM member m JOIN (SELECT attribute, grp, median(disc) AS disc, median(qty) AS qty FROM member GROUP BY attribute, grp) f USING (attribute, grp)),
labelled AS (SELECT row_id, okey, attribute, grp, x1, x2, 'y1' AS outcome, y1 AS y FROM filled
  UNION ALL SELECT row_id, okey, attribute, grp, x1, x2, 'y2', y2 FROM filled),
{S.folds('labelled', 'f', 2, 'attribute, grp, outcome')},
parts AS (SELECT attribute, grp, outcome, x1, x2, y, -1 AS left_out FROM f
  UNION ALL SELECT attribute, grp, outcome, x1, x2, y, CAST(h AS INTEGER) FROM f, range(2) t(h) WHERE h <> fold)"""


@query("q_log_reg", f"""
WITH RECURSIVE {S.SPLIT}, {_TWO_ROWS}, {S.logistic('parts', 'lr', 'attribute, grp, outcome, left_out')}
SELECT attribute, grp, outcome, left_out, round(w1, 6) AS w_disc, round(w2, 6) AS w_qty, round(w0, 6) AS intercept FROM lr""")
def log_reg_parts(spark, folder):
    """Logistic regression on two features in every scope and outcome: on all training rows and on either half, in one go."""
    study = ST.prepare(C.orders_cohort(spark, folder), ST.StudySpec(_TWO, C.ORDER_REGISTRY, algorithms=("log-reg",), calibrated_cv=False))
    rows = [(p.attribute, p.grp, p.outcome, p.fold, *w.tolist()) for p, w in ST.linear_coefficients(study, ("final", "inner")).items()]
    weights = ("w_disc", "w_qty", "intercept")
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in ("attribute", "grp", "outcome")], T.StructField("left_out", T.IntegerType()),
                           *[T.StructField(c, T.DoubleType()) for c in weights]])
    return _rounded(local_table(spark, rows, schema), weights)


def _plan_sql() -> str:
    """Folds of every scope and outcome by row numbers: population, subgroups, outer folds, halves, halves without an outer fold."""
    keys = "attribute, grp, outcome"
    named = lambda source, name, fold, held="-1": (
        f"SELECT {keys}, '{name}' AS name, {held} AS held_out, {fold} AS fold, y, row_id FROM {source}")
    return f"""
WITH {S.SPLIT}, train AS (SELECT * FROM split WHERE NOT is_test), {S.member('train')},
long AS (SELECT row_id, okey, attribute, grp, 'y1' AS outcome, y1 AS y FROM member
  UNION ALL SELECT row_id, okey, attribute, grp, 'y2', y2 FROM member),
everyone AS (SELECT * FROM long WHERE attribute = 'all'), grouped AS (SELECT * FROM long WHERE attribute <> 'all'),
{S.folds('everyone', 'a', 3, keys)}, {S.folds('grouped', 'g', 2, keys)}, {S.folds('long', 'o', 5, keys)}, {S.folds('long', 'i', 2, keys)},
parts AS (SELECT o.* EXCLUDE (fold), CAST(h AS INTEGER) AS held FROM o, range(5) t(h) WHERE h <> fold),
{S.folds('parts', 'n', 2, keys + ', held')},
every AS ({named('a', 'cv', 'fold')} UNION ALL {named('g', 'cv', 'fold')} UNION ALL {named('o', 'outer', 'fold')}
  UNION ALL {named('i', 'inner', 'fold')} UNION ALL {named('n', 'inner', 'fold', 'held')})
SELECT {keys}, name, held_out, fold, y, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM every GROUP BY ALL"""


@query("q_fold_plan", _plan_sql())
def fold_plan(spark, folder):
    """All folds that a study trains on, found in two passes: rows and ids of each, by class."""
    study = ST.prepare(C.orders_cohort(spark, folder), ST.StudySpec(_TWO, C.ORDER_REGISTRY, algorithms=("log-reg",)))
    rows = linear.numbered_rows(read_split(study.table, "train"), study.features, study.outcomes, study.plan, study.scopes)
    slots = linear.fold_slots(study.plan)
    named = [(*s.key, o, i, *slot) for s in study.scopes for i, o in enumerate(study.outcomes) for slot in slots]
    fields = [("attribute", T.StringType()), ("grp", T.StringType()), ("outcome", T.StringType()), ("place", T.IntegerType()),
              ("name", T.StringType()), ("held_out", T.IntegerType()), ("slot", T.IntegerType()), ("outer", T.IntegerType())]
    # every numbering knows its own place in a row's bytes, and that of the outer folds it belongs to
    table = [(*x, n + 1, n - n % len(slots) + slots.index(("outer", -1)) + 1) for n, x in enumerate(named)]
    numberings = local_table(spark, table, T.StructType([T.StructField(c, t) for c, t in fields]))
    byte = lambda at: F.conv(F.hex(F.substring("folds", F.col(at), F.lit(1))), 16, 10).cast("int")
    long = rows.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(len(named))))).join(F.broadcast(numberings), "slot").select(
        "row_id", "attribute", "grp", "outcome", "name", "held_out", byte("slot").alias("fold"), byte("outer").alias("own"), F.get("y", "place").alias("y"))
    # the numbers that a row of the held out fold has inside the part without it mean nothing
    inside = (F.col("fold") != linear.OUTSIDE) & (F.col("own") != F.col("held_out"))
    return long.where(inside).groupBy("attribute", "grp", "outcome", "name", "held_out", "fold", "y").agg(
        F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


def _rounded(df, columns, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


def _documents(**options):
    base = dict(algorithms=("dt", "log-reg", "gb"), attributes=("lang",), parallel_fits=8,
                settings=ModelSettings(tree_depth=5, logistic_iterations=100, stump_rounds=10))
    return ST.StudySpec(C.DOCUMENT_SPEC, C.DOCUMENT_REGISTRY, **{**base, **options})


def _strategies(spark, folder, wanted, **options):
    spec = _documents(calibrated_cv=False, ensemble_cv=False, **options)
    out = ST.run_study(C.documents_cohort(spark, folder), spec)["evaluation"]
    return out.where(F.col("strategy").isin(*wanted)).select(
        "outcome", "strategy", "ensemble", "attribute", "grp", *EVALUATION_METRICS)


@query("m_bottom_up")
def bottom_up(spark, folder):
    """Runners-up plus each group's winner, all fitted on everyone."""
    return _strategies(spark, folder, ["ensemble_on_all"])


@query("m_top_down")
def top_down(spark, folder):
    """Best on everyone plus runners-up, fitted inside each group."""
    return _strategies(spark, folder, ["ensemble_on_group"])


@query("m_prefit")
def prefit(spark, folder):
    """As the first, but each group's winner votes as fitted on its group."""
    return _strategies(spark, folder, ["ensemble_on_all"], refit=False)


@query("m_study")
def whole_study(spark, folder):
    """All phases on labelled documents; returns the table of the four strategies per group."""
    spec = _documents(algorithms=("dt", "log-reg"), folds_outer=3)
    return ST.run_study(C.documents_cohort(spark, folder), spec)["strategies_by_group"]


