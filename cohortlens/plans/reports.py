"""Comparison tables. Inputs are evaluation tables: a few rows per outcome and group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.rounding import percent_1dp
from cohortlens.operators.metrics import EVALUATION_METRICS
from cohortlens.operators.subgroups import ALL


def side_by_side(rows: DataFrame, keys: Sequence[str], variant: str, variants: Sequence[str]) -> DataFrame:
    """One row per key and metric, one percent column per variant.

    Rows meet by key, so variants may come in any order; a missing one is null.
    """
    metric = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), percent_1dp(m).alias("pct")) for m in EVALUATION_METRICS
    ]))
    long = rows.select(*keys, variant, metric.alias("_e")).select(*keys, variant, "_e.metric", "_e.pct")
    return long.groupBy(*keys, "metric").agg(*[
        F.max(F.when(F.col(variant) == v, F.col("pct"))).alias(v) for v in variants
    ])


def calibration_overall(evaluation: DataFrame, calibrations: Sequence[str] = ("raw", "isotonic")) -> DataFrame:
    """Whole population: the shared model before and after recalibration."""
    rows = evaluation.where((F.col("strategy") == "one_for_all") & (F.col("attribute") == ALL))
    return side_by_side(rows, ["outcome"], "calibration", calibrations)


def calibration_by_group(evaluation: DataFrame, calibrations: Sequence[str] = ("raw", "isotonic")) -> DataFrame:
    """Each subgroup: the shared model before and after recalibration."""
    rows = evaluation.where((F.col("strategy") == "one_for_all") & (F.col("attribute") != ALL))
    return side_by_side(rows, ["outcome", "attribute", "grp"], "calibration", calibrations)


def single_vs_ensembles(evaluation: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Whole population: the shared model next to one ensemble per attribute."""
    rows = evaluation.where(
        (F.col("attribute") == ALL) & (F.col("calibration") == "raw")
        & F.col("strategy").isin("one_for_all", "ensemble_on_all")
    ).withColumn("variant", F.when(F.col("strategy") == "one_for_all", "single_model")
                 .otherwise(F.concat(F.lit("ensemble_by_"), F.col("ensemble"))))
    return side_by_side(rows, ["outcome"], "variant", ["single_model", *[f"ensemble_by_{a}" for a in attributes]])


def strategies_by_group(evaluation: DataFrame) -> DataFrame:
    """Each subgroup: the four strategies next to each other.

    A group is listed if any strategy has a value; one that could not be trained there is null.
    """
    from cohortlens.plans.evaluation import STRATEGIES

    rows = evaluation.where((F.col("attribute") != ALL) & (F.col("calibration") == "raw"))
    return side_by_side(rows, ["outcome", "attribute", "grp"], "strategy", STRATEGIES)


def chart_limits(report: DataFrame, keys: Sequence[str], variants: Sequence[str]) -> DataFrame:
    """Largest percentage shown per chart."""
    shown = [F.col(v) for v in variants]
    return report.groupBy(*keys).agg(F.max(F.greatest(*shown) if len(shown) > 1 else shown[0]).alias("highest"))
