"""Feature preparation: imputation, standardising, vector assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cohortlens.operators.orderstats import exact_medians, present


def fit_fill_values(
    df: DataFrame, columns: Sequence[str], strategy: str = "median", keys: Sequence[str] = (), accuracy: int = 10_000
) -> DataFrame:
    """One row per key with the fill value of every column.

    ``median`` is exact, ``mean`` is the average, ``approx_median`` costs a single
    pass with a rank error of ``1 / accuracy``.
    """
    if strategy == "median":
        return exact_medians(df, columns, keys)
    if strategy == "mean":
        return df.groupBy(*keys).agg(*[F.avg(present(c)).alias(c) for c in columns])
    if strategy == "approx_median":
        return df.groupBy(*keys).agg(
            *[F.percentile_approx(present(c), 0.5, accuracy).alias(c) for c in columns]
        )
    raise ValueError("strategy is 'median', 'mean' or 'approx_median'")


def filled(columns: Sequence[str], values: Mapping[str, float] | Row, empty: float = 0.0) -> list[Column]:
    """Columns with nulls and NaN replaced by fitted values.

    A column without any value in training has no fill value; it becomes the
    constant ``empty``, which no model can learn from.
    """
    values = values.asDict() if isinstance(values, Row) else dict(values)
    return [
        F.coalesce(present(c), F.lit(float(empty if values.get(c) is None else values[c]))).alias(c)
        for c in columns
    ]


def impute(train: DataFrame, df: DataFrame, columns: Sequence[str], strategy: str = "median") -> DataFrame:
    """Fill ``df`` with values fitted on ``train``; the fit itself is one row of numbers."""
    fill = {c: v for c, v in zip(columns, filled(columns, fit_fill_values(train, columns, strategy).first()))}
    return df.select(*[fill.get(c, F.col(c)) for c in df.columns])


def standardize(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre and scale by the population deviation of ``train``; a constant column is only centred."""
    fit = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()

    def scaled(c: str) -> Column:
        return ((F.col(c) - F.lit(fit[f"m_{c}"])) / F.lit(fit[f"s_{c}"] or 1.0)).alias(c)

    return df.select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """Add one vector column; nulls are an error because imputation comes first."""
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="error").transform(df)


def outside_range(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows whose value breaks the given bounds. Nothing is dropped for it."""
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return df.where(bad)
