"""From raw columns to one numeric table per cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.encode import fit_levels, one_hot_columns, slug
from cohortlens.functions.rules import KeywordRule, equals_flag, keyword_bucket, member_flag


@dataclass(frozen=True)
class Bucketed:
    """A text column turned into ordered keyword buckets."""

    source: str
    rules: tuple[KeywordRule, ...]
    default: str
    normalize: str | None = "lower"


@dataclass(frozen=True)
class Outcome:
    """A 0/1 label: the source column holds one of ``values``."""

    source: str
    values: tuple
    normalize: str | None = None


@dataclass(frozen=True)
class CohortSpec:
    """What a cohort table consists of.

    ``categorical`` maps each column to its reference level, the one that gets no
    indicator column (``None`` keeps them all). ``carry`` columns are passed through
    for subgroup conditions.
    """

    row_id: str
    numeric: tuple[str, ...]
    categorical: Mapping[str, str | None]
    outcomes: Mapping[str, Outcome]
    buckets: Mapping[str, Bucketed] = field(default_factory=dict)
    carry: tuple[str, ...] = ()


def derive(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """Add bucket and outcome columns; one projection, no pass over the data."""
    new = {name: keyword_bucket(b.source, b.rules, b.default, b.normalize) for name, b in spec.buckets.items()}
    for name, o in spec.outcomes.items():
        one = len(o.values) == 1
        new[name] = equals_flag(o.source, o.values[0], o.normalize) if one else member_flag(o.source, o.values, o.normalize)
    return df.withColumns(new) if new else df


def fit_cohort_levels(
    df: DataFrame, spec: CohortSpec, sep: str | None = None, max_levels: int | None = None
) -> dict[str, list[str]]:
    """Levels of every categorical column, to be kept with the models trained on them."""
    return fit_levels(df, list(spec.categorical), sep, max_levels)


def feature_table(df: DataFrame, spec: CohortSpec, levels: Mapping[str, Sequence[str]]) -> tuple[DataFrame, list[str]]:
    """Numeric and one-hot features, outcomes and carried columns in one ``select``.

    Returns the table and the names of its feature columns, numeric ones first; names
    are in snake case. ``df`` has been through :func:`derive`.
    """
    reference = {c: r for c, r in spec.categorical.items() if r is not None}
    indicators = one_hot_columns({c: levels[c] for c in spec.categorical}, reference)
    carried = [c for c in spec.carry if c != spec.row_id]
    out = df.select(
        F.col(spec.row_id).alias("row_id"),
        *[F.col(c).cast("double").alias(slug(c)) for c in spec.numeric],
        *indicators,
        *[F.col(o) for o in spec.outcomes],
        *[F.col(c) for c in carried],
    )
    clash = sorted({c for c in out.columns if out.columns.count(c) > 1})
    if clash:
        raise ValueError(f"several columns would be called {clash}; rename them in the cohort")
    n_features = len(spec.numeric) + len(indicators)
    return out, out.columns[1: 1 + n_features]


def features_and_outcomes(
    df: DataFrame, features: Sequence[str], outcomes: Sequence[str], row_id: str = "row_id"
) -> tuple[DataFrame, DataFrame]:
    """The feature side and the label side of a table, both keyed by row."""
    return df.select(row_id, *features), df.select(row_id, *outcomes)
