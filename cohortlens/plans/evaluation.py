"""Performance per subgroup of the four modelling strategies.

Predictions are long: ``scope_attribute, scope_grp, outcome, algorithm,
calibration, y, p, yhat`` plus the columns that subgroup conditions use. All
groups, outcomes and calibrations come from one aggregate per strategy.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.metrics import (
    EVALUATION_METRICS, classification_metrics, cv_summary, cv_wide, fold_scores, subgroup_metrics,
)
from cohortlens.operators.selection import SELECTION_METRIC, best_models, drop_repeats, union_all
from cohortlens.operators.subgroups import ALL, Registry, member_pattern, spread_pattern
from cohortlens.operators.training import plan_folds
from cohortlens.operators.votes import p_col, yhat_col
from cohortlens.session import local_table, settled

STRATEGIES = ("one_for_all", "one_per_group", "ensemble_on_all", "ensemble_on_group")
RESULT_COLUMNS = ("outcome", "strategy", "calibration", "ensemble", "attribute", "grp", *EVALUATION_METRICS)


def by_outcome(df: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """One row per outcome with its label as ``y``; scores stay side by side."""
    entries = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("y")) for o in outcomes])
    return df.withColumn("_e", F.explode(entries)).select(
        *[c for c in df.columns if c not in outcomes], F.col("_e.outcome"), F.col("_e.y"))


def by_model(df: DataFrame, models: Sequence[str], scores: bool = True) -> DataFrame:
    """One row per model with its ``p`` and ``yhat``; without ``scores``, with ``yhat`` alone."""
    entries = F.array(*[
        F.struct(F.lit(m).alias("algorithm"), F.lit(i).alias("ordinal"),
                 *([F.col(p_col(m)).alias("p")] if scores else []), F.col(yhat_col(m)).alias("yhat"))
        for i, m in enumerate(models)
    ])
    dropped = {c for m in models for c in (p_col(m), yhat_col(m))}
    return df.withColumn("_e", F.explode(entries)).select(*[c for c in df.columns if c not in dropped], "_e.*")


def long_by_outcome(df: DataFrame, outcomes: Sequence[str], models: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Unpivot outcomes x models of a wide row, without a shuffle."""
    cols = [*keep, *outcomes, *[c for m in models for c in (p_col(m), yhat_col(m))]]
    return by_model(by_outcome(df.select(*cols), outcomes), models)


def scope_cv_scores(predictions: DataFrame, fold: str = "fold", weight: str | None = None) -> DataFrame:
    """Mean CV scores per scope, outcome and algorithm, wide."""
    keys = ["attribute", "grp", "outcome", "algorithm", "ordinal"]
    return cv_wide(cv_summary(fold_scores(predictions, keys, fold, weight=weight), keys, fold), keys)


def folded_cells(
    train: DataFrame, registry: Registry, outcomes: Sequence[str], models: Sequence[str], sizes: Mapping[str, int], seed: int
) -> DataFrame:
    """The scores of every scope, outcome and model by fold, equal ones as one row with their count ``n``.

    ``train`` carries its order key as ``okey``. Rows are counted by membership pattern, labels, score and the
    stretch of the key axis between two fold ends, and spread over scopes and outcomes afterwards: a row's fold
    in every scope follows from its stretch.
    """
    plan = plan_folds(train, registry, outcomes, {"outer": 2, "inner": 2, **sizes}, seed, nested=False)
    named = {key[1:4]: ends for key, ends in plan.ends.items() if key[0] == "cv"}
    cuts = sorted({e for ends in named.values() for of in ends.values() for e in of})
    place = {e: i for i, e in enumerate(cuts)}
    bits = len(cuts).bit_length()
    # no key sorts behind the last ones
    edges = F.array(*[F.lit(e) for e in [*cuts, *["~"] * ((1 << bits) - 1 - len(cuts))]]) if cuts else F.array(F.lit("~"))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(bits, 1)))])
    stretch = F.aggregate(steps, F.lit(0), lambda i, h: F.when(F.get(edges, i + h - 1) < F.col("okey"), i + h).otherwise(i))
    groups = registry.active()
    rows = by_model(train.select(
        member_pattern(groups).alias("_in"), *outcomes, stretch.alias("_at"), *[c for m in models for c in (p_col(m), yhat_col(m))]), models)
    columns = ["_in", *outcomes, "_at", "algorithm", "ordinal", "p", "yhat"]
    cells = settled(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")), "cells")
    table = [(*at, label, [place[e] for e in of]) for at, ends in named.items() for label, of in ends.items()]
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in ("attribute", "grp", "outcome")], T.StructField("y", T.IntegerType()),
                           T.StructField("_ends", T.ArrayType(T.IntegerType()))])
    long = spread_pattern(by_outcome(cells, outcomes), groups, "_in").withColumn("y", F.col("y").cast("int"))
    folds = local_table(train.sparkSession, table, schema)
    return long.join(F.broadcast(folds), ["attribute", "grp", "outcome", "y"]).withColumn(
        "fold", F.size(F.filter("_ends", lambda e: e < F.col("_at")))).drop("_ends", "_at")


def _named(df: DataFrame, strategy: str, calibration=None, ensemble=None) -> DataFrame:
    extra = {"strategy": F.lit(strategy)}
    if calibration is not None:
        extra["calibration"] = calibration
    if "ensemble" not in df.columns:
        extra["ensemble"] = F.lit(None).cast("string") if ensemble is None else ensemble
    return df.withColumns(extra).select(*RESULT_COLUMNS)


def one_for_all(predictions: DataFrame, best: DataFrame, registry: Registry, weight: str | None = None) -> DataFrame:
    """The best whole-population model, on everyone and on each subgroup, per calibration.

    ``best``: ``outcome, algorithm``. Only its predictions go on to the aggregate.
    """
    chosen = predictions.join(best.select("outcome", "algorithm"), ["outcome", "algorithm"])
    return _named(subgroup_metrics(chosen, registry, ["outcome", "calibration"], weight=weight), "one_for_all")


def one_per_group(predictions: DataFrame, best: DataFrame, weight: str | None = None) -> DataFrame:
    """Each subgroup's own best model on the subgroup. ``best``: ``outcome, attribute, grp, algorithm``."""
    keys = ["outcome", "attribute", "grp"]
    chosen = predictions.where(F.col("calibration") == "raw").join(
        best.select(*keys, "algorithm"), [*keys, "algorithm"]
    )
    return _named(classification_metrics(chosen, keys, weight=weight), "one_per_group", F.lit("raw"))


def ensemble_on_all(votes: DataFrame, registry: Registry, vote: str = "hard", weight: str | None = None) -> DataFrame:
    """Ensembles of the whole population, on everyone and on the groups of their own attribute."""
    scores = subgroup_metrics(votes, registry, ["outcome", "ensemble"], yhat=f"yhat_{vote}", weight=weight)
    own = scores.where((F.col("attribute") == ALL) | (F.col("attribute") == F.col("ensemble")))
    return _named(own, "ensemble_on_all", F.lit("raw"))


def ensemble_on_group(votes: DataFrame, vote: str = "hard", weight: str | None = None) -> DataFrame:
    """Ensembles trained inside a subgroup, on that subgroup."""
    scores = classification_metrics(votes, ["outcome", "attribute", "grp"], yhat=f"yhat_{vote}", weight=weight)
    return _named(scores, "ensemble_on_group", F.lit("raw"))


def evaluation_table(parts: Sequence[DataFrame]) -> DataFrame:
    """All strategies in one table. The whole-population rows occur once each."""
    stacked = union_all([p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    return drop_repeats(stacked, "_part").drop("_part")


def winners(cv_scores: DataFrame, metric: Mapping[str, str] | str = SELECTION_METRIC) -> DataFrame:
    """Best algorithm per outcome and scope (``all`` or a subgroup)."""
    return best_models(cv_scores, ["outcome", "attribute", "grp"], metric)
