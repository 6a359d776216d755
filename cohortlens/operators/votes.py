"""Votes over the predictions a row already carries.

A row holds ``p__<model>`` and ``yhat__<model>`` per member, so a vote is a
per-row expression: no shuffle, whatever the number of rows. Members fitted on
the same rows with the same algorithm are the same model, so repeated members
are carried as a weight instead of being fitted again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def p_col(model: str) -> str:
    return f"p__{model}"


def yhat_col(model: str) -> str:
    return f"yhat__{model}"


def with_classes(df: DataFrame, models: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Add ``yhat__<model>`` = 1 where the probability is above the threshold."""
    return df.withColumns({yhat_col(m): F.when(F.col(p_col(m)) > threshold, 1).otherwise(0) for m in models})


def hard_vote(weights: Mapping[str, int]) -> Column:
    """1 if more than half of the votes are for 1; a tie goes to 0."""
    total = sum(weights.values())
    votes = reduce(add, [F.col(yhat_col(m)) * w for m, w in weights.items()])
    return F.when(votes * 2 > total, 1).otherwise(0)


def soft_score(weights: Mapping[str, int]) -> Column:
    """Weighted mean probability."""
    total = float(sum(weights.values()))
    return reduce(add, [F.col(p_col(m)) * float(w) for m, w in weights.items()]) / total


def soft_vote(weights: Mapping[str, int]) -> Column:
    """1 if the mean probability is above one half; a tie goes to 0, and so does a missing member."""
    score = soft_score(weights)
    return F.when((score > 0.5) & ~F.isnan(score), 1).otherwise(0)  # NaN sorts above every number


def member_weights(members: DataFrame, ensemble: Sequence[str]) -> DataFrame:
    """``(ensemble, algorithm, weight)``: repeated members become a weight."""
    return members.groupBy(*ensemble, "algorithm").agg(F.count(F.lit(1)).alias("weight"))


def ensemble_members(
    base: DataFrame, winners: DataFrame, attribute_order: Sequence[str], accumulate: bool = False
) -> DataFrame:
    """Long member list per outcome and attribute: base models plus each group's winner.

    ``base``: ``outcome, algorithm``. ``winners``: ``outcome, attribute, grp, algorithm``.
    With ``accumulate``, an attribute also keeps the winners of the attributes before it.
    """
    rank = F.array_position(F.array(*[F.lit(a) for a in attribute_order]), F.col("attribute"))
    steps = winners.withColumn("_rank", rank).where(F.col("_rank") > 0)
    later = F.sequence(F.col("_rank"), F.lit(len(attribute_order)) if accumulate else F.col("_rank"))
    names = F.array(*[F.lit(a) for a in attribute_order])
    own = steps.withColumn("_step", F.explode(later)).select(
        "outcome", F.element_at(names, F.col("_step").cast("int")).alias("ensemble"), "algorithm",
        F.concat_ws("/", "attribute", "grp").alias("origin"),
    )
    shared = base.select(
        "outcome", F.explode(names).alias("ensemble"), "algorithm", F.lit("base").alias("origin")
    )
    return shared.unionByName(own)


def collect_weights(members: DataFrame, order: Sequence[str]) -> dict[tuple[str, str], dict[str, int]]:
    """Weights per (outcome, ensemble), models in registry order. A handful of rows."""
    found: dict[tuple[str, str], dict[str, int]] = {}
    for r in member_weights(members, ["outcome", "ensemble"]).collect():
        found.setdefault((r["outcome"], r["ensemble"]), {})[r["algorithm"]] = r["weight"]
    return {k: {m: w[m] for m in order if m in w} for k, w in sorted(found.items())}


def vote_table(
    df: DataFrame, ensembles: Mapping[tuple[str, str], Mapping[str, int]], keep: Sequence[str], soft: bool = True
) -> DataFrame:
    """Long table ``keep, outcome, y, ensemble, yhat_hard, p_soft, yhat_soft``: all ensembles in one pass.

    Without ``soft``, hard votes only.

    ``df`` has one row per row and outcome, with the scores of all members side by side.
    """
    def entry(name: str, w: Mapping[str, int]) -> Column:
        both = [soft_score(w).alias("p_soft"), soft_vote(w).alias("yhat_soft")] if soft else []
        return F.struct(F.lit(name).alias("ensemble"), hard_vote(w).alias("yhat_hard"), *both)

    entries = F.array_compact(F.array(*[
        F.when(F.col("outcome") == o, entry(e, w)) for (o, e), w in ensembles.items()
    ]))
    cols = [c for c in (*keep, "outcome", "y") if c in df.columns]
    cols = list(dict.fromkeys(cols))
    return df.withColumn("_e", F.explode(entries)).select(*cols, "_e.*")


def predictions_wide(
    df: DataFrame, keep: Sequence[str], name_cols: Sequence[str] = ("algorithm", "calibration"),
    names: Sequence[str] = (), value: str = "yhat",
) -> DataFrame:
    """Pivot long predictions to one column per model; ``names`` fixes the columns up front."""
    named = df.withColumn("_name", F.concat_ws("__", *name_cols))
    return named.groupBy(*keep).pivot("_name", list(names) or None).agg(F.max(value))


def predictions_long(df: DataFrame, keep: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Unpivot ``p__m`` and ``yhat__m`` to ``keep, algorithm, p, yhat``."""
    entries = F.array(*[
        F.struct(F.lit(m).alias("algorithm"), F.col(p_col(m)).alias("p"), F.col(yhat_col(m)).alias("yhat"))
        for m in models
    ])
    return df.select(*keep, F.explode(entries).alias("_e")).select(*keep, "_e.algorithm", "_e.p", "_e.yhat")
