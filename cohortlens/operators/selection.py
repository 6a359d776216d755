"""Choosing models by cross-validated scores. Works on small score tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.metrics import CV_METRICS

#: metric that decides per outcome (fixed values)
SELECTION_METRIC = {"y1": "f1", "y2": "accuracy"}


def metric_by_outcome(config: Mapping[str, str] | str, outcome: str = "outcome") -> Column:
    """The value of the metric that decides for this outcome; NaN counts as missing."""
    def value(metric: str) -> Column:
        if metric not in CV_METRICS:
            raise ValueError(f"metric {metric!r} is not computed in cross-validation")
        return F.when(F.isnan(metric), F.lit(None)).otherwise(F.col(metric))

    if isinstance(config, str):
        return value(config)
    out: Column | None = None
    for name, metric in config.items():
        hit = F.col(outcome) == name
        out = F.when(hit, value(metric)) if out is None else out.when(hit, value(metric))
    return out


def ranked_models(
    scores: DataFrame, scope: Sequence[str], metric: Mapping[str, str] | str = "f1", order: str = "ordinal"
) -> DataFrame:
    """Add ``deciding_value`` and ``model_rank`` per scope: best first, ties in registry order.

    Models without a value rank after all others.
    """
    scored = scores.withColumn("deciding_value", metric_by_outcome(metric))
    w = Window.partitionBy(*scope).orderBy(F.desc_nulls_last("deciding_value"), F.col(order))
    return scored.withColumn("model_rank", F.row_number().over(w))


def best_models(
    scores: DataFrame, scope: Sequence[str], metric: Mapping[str, str] | str = "f1", order: str = "ordinal"
) -> DataFrame:
    """One row per scope: the winner. A scope where no model has a value has no row."""
    return (
        ranked_models(scores, scope, metric, order)
        .where((F.col("model_rank") == 1) & F.col("deciding_value").isNotNull())
        .withColumn("algorithm", F.trim("algorithm"))
        .drop("model_rank")
    )


def runners_up(
    scores: DataFrame, scope: Sequence[str], metric: Mapping[str, str] | str = "f1", order: str = "ordinal",
    ranks: Sequence[int] = (2, 3),
) -> DataFrame:
    """The models at the given ranks, by default second and third."""
    return ranked_models(scores, scope, metric, order).where(F.col("model_rank").isin(*ranks))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack result tables by column name; a column missing in one is null there."""
    if not frames:
        raise ValueError("nothing to stack")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def drop_repeats(df: DataFrame, ordinal: str) -> DataFrame:
    """Remove exact repeats of a row, keeping the smallest ``ordinal`` of each."""
    cols = [c for c in df.columns if c != ordinal]
    return df.groupBy(*cols).agg(F.min(ordinal).alias(ordinal)).select(*df.columns)
