"""Classification metrics as grouped aggregates.

Everything except the area under the curve comes from one hash aggregate of four
counts: rows are combined before the shuffle, so a group with most of the rows
costs as little to shuffle as a small one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.subgroups import Registry, member_pattern, spread_pattern
from cohortlens.operators.votes import yhat_col
from cohortlens.session import settled

EVALUATION_METRICS = ("accuracy", "f1", "precision", "recall")
COUNTS = ("n", "tp", "fp", "fn", "tn")
CV_METRICS = ("accuracy", "balanced_accuracy", "f1", "precision_macro", "recall_macro", "roc_auc")

#: scikit-learn 1.0 widens the unit interval by this much before cutting it into bins (fixed value)
BIN_WIDENING = 1e-8


def _ratio(num: Column, den: Column) -> Column:
    """0 when undefined."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def confusion_counts(df: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat", weight: str | None = None) -> DataFrame:
    """``n, tp, fp, fn, tn`` as long per key; a row counts as often as ``weight`` says."""
    t, p = F.col(y), F.col(yhat)
    cases = {"tp": (t == 1) & (p == 1), "fp": (t == 0) & (p == 1), "fn": (t == 1) & (p == 0), "tn": (t == 0) & (p == 0)}
    if weight:
        counts = [F.sum(weight).alias("n"), *[F.sum(F.when(c, F.col(weight)).otherwise(0)).alias(name) for name, c in cases.items()]]
    else:
        counts = [F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(name) for name, c in cases.items()]]
    return df.groupBy(*keys).agg(*counts)


def metric_columns() -> dict[str, Column]:
    """Metric expressions over the columns of :func:`confusion_counts`."""
    n, tp, fp, fn, tn = (F.col(c) for c in ("n", "tp", "fp", "fn", "tn"))
    has1, has0 = (tp + fp + fn) > 0, (tn + fp + fn) > 0
    labels = has1.cast("int") + has0.cast("int")
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    precision0, recall0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    true_classes = ((tp + fn) > 0).cast("int") + ((tn + fp) > 0).cast("int")

    def over_labels(one: Column, zero: Column) -> Column:
        return (F.when(has1, one).otherwise(0.0) + F.when(has0, zero).otherwise(0.0)) / labels

    return {
        "accuracy": (tp + tn) / n,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "precision": precision,
        "recall": recall,
        "precision_macro": over_labels(precision, precision0),
        "recall_macro": over_labels(recall, recall0),
        # only classes that occur among the true labels count
        "balanced_accuracy": (recall + recall0) / true_classes,
    }


def _with_metrics(counts: DataFrame, keys: Sequence[str], metrics: Sequence[str], keep_counts: bool) -> DataFrame:
    exprs = metric_columns()
    unknown = [m for m in metrics if m not in exprs]
    if unknown:
        raise ValueError(f"unknown metric(s) {unknown}; expected {sorted(exprs)}")
    kept = list(COUNTS) if keep_counts else []
    return counts.select(*keys, *kept, *[exprs[m].alias(m) for m in metrics])


def classification_metrics(
    df: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat",
    metrics: Sequence[str] = EVALUATION_METRICS, keep_counts: bool = False, weight: str | None = None,
) -> DataFrame:
    """One row per key with the named metrics."""
    return _with_metrics(confusion_counts(df, keys, y, yhat, weight), keys, metrics, keep_counts)


def subgroup_metrics(
    df: DataFrame, registry: Registry, keys: Sequence[str], y: str = "y", yhat: str = "yhat",
    metrics: Sequence[str] = EVALUATION_METRICS, keep_counts: bool = False, attributes: Sequence[str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Metrics of everyone and of each subgroup: ``keys, attribute, grp, ...``.

    Counts are formed per membership pattern and only then spread over the groups,
    so rows are not multiplied by the number of groups they are in.
    """
    groups = registry.active(attributes)
    counts = confusion_counts(df.withColumn("_in", member_pattern(groups)), [*keys, "_in"], y, yhat, weight)
    by = [*keys, "attribute", "grp"]
    spread = spread_pattern(counts, groups, "_in").groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return _with_metrics(spread, by, metrics, keep_counts)


def scorer_metrics(
    df: DataFrame, registry: Registry, outcomes: Sequence[str], models: Sequence[str],
    metrics: Sequence[str] = EVALUATION_METRICS, keep_counts: bool = False,
) -> DataFrame:
    """As :func:`subgroup_metrics` for wide rows with ``yhat__<model>``, all outcomes and models in one scan.

    Every outcome and model has its own counters in one aggregate row per pattern; the
    table is made long after that, so no input row is copied.
    """
    groups = registry.active()
    cells = [(o, m) for o in outcomes for m in models]

    def counters(o: str, m: str) -> list[Column]:
        t, p = F.col(o), F.col(yhat_col(m))
        return [F.count_if((t == a) & (p == b)).alias(f"{c}__{o}__{m}")
                for c, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]

    wide = df.groupBy(member_pattern(groups).alias("_in")).agg(
        F.count(F.lit(1)).alias("n"), *[c for o, m in cells for c in counters(o, m)])
    entries = F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.lit(m).alias("algorithm"), F.col("n"),
                 *[F.col(f"{c}__{o}__{m}").alias(c) for c in COUNTS[1:]]) for o, m in cells
    ])
    long = spread_pattern(wide.select("_in", F.explode(entries).alias("_e")).select("_in", "_e.*"), groups, "_in")
    by = ["outcome", "algorithm", "attribute", "grp"]
    return _with_metrics(long.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS]), by, metrics, keep_counts)


def _slice_of(score: Column, edges: Column, log2_slices: int) -> Column:
    """How many of the sorted ``2**log2_slices - 1`` edges are <= score, by bisection."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(log2_slices))])
    return F.aggregate(
        steps, F.lit(0), lambda i, h: F.when(F.get(edges, i + h - 1) <= score, i + h).otherwise(i)
    )


def _ranked_totals(
    df: DataFrame, keys: Sequence[str], y: str, score: str, log2_slices: int, sums: dict[str, Column] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Per key: positives ``_p``, negatives ``_n``, won pairs ``_wins``, and sums of further row values.

    ``weight`` names a column that says for how many equal rows a row stands.
    """
    sums = sums or {}
    times = F.col(weight) if weight else F.lit(1).cast("long")
    extra = [F.sum(c * times).alias(name) for name, c in sums.items()]
    again = [F.sum(name).alias(name) for name in sums]
    ties = df.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.sum(F.col(y).cast("long") * times).alias("_pos"), F.sum((1 - F.col(y).cast("long")) * times).alias("_neg"), *extra
    )
    n_slices = 1 << log2_slices
    # different scores with their counts are stored: the edges of every key and the slices read them
    ties = settled(ties, "ties")
    quantiles = F.percentile_approx("_s", [i / n_slices for i in range(1, n_slices)], 10 * n_slices)
    if keys:
        edges = settled(ties.groupBy(*keys).agg(quantiles.alias("_edges")), "edges")
        same = [ties[k].eqNullSafe(edges[k]) for k in keys]
        sliced = ties.join(edges, reduce(lambda a, b: a & b, same)).select(ties["*"], "_edges")
    else:
        sliced = ties.withColumn("_edges", ties.agg(quantiles).scalar())
    sliced = sliced.withColumn("_slice", _slice_of(F.col("_s"), F.col("_edges"), log2_slices)).drop("_edges")
    inside = Window.partitionBy(*keys, "_slice").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    pos, neg = F.col("_pos").cast("double"), F.col("_neg").cast("double")
    slices = (
        sliced.withColumn("_below", F.coalesce(F.sum("_neg").over(inside), F.lit(0)).cast("double"))
        .groupBy(*keys, "_slice")
        .agg(
            F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"),
            F.sum(pos * (F.col("_below") + neg / 2)).alias("_w"), *again,
        )
    )
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("_w") + F.col("_p").cast("double") * F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("double")
    return slices.withColumn("_wins", wins).groupBy(*keys).agg(
        F.sum("_wins").alias("_wins"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), *again
    )


def _auc_column() -> Column:
    pairs = F.col("_p").cast("double") * F.col("_n").cast("double")
    return F.when(pairs == 0, F.lit(float("nan"))).otherwise(F.col("_wins") / pairs)


def roc_auc(
    df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "p", log2_slices: int = 9
) -> DataFrame:
    """Exact area under the ROC curve per key, ties counted half; NaN with one class.

    A rank over all rows of a key would put a large key into one task. Instead:
    equal scores collapse to one row of counts (combined before the shuffle), the
    score axis is cut at quantiles of the remaining scores, a window runs inside
    each (key, slice), and a second window adds up whole slices, at most
    ``2**log2_slices`` rows per key. More slices mean smaller tasks, same result.
    """
    return _ranked_totals(df, keys, y, score, log2_slices).select(*keys, _auc_column().alias("roc_auc"))


def fold_scores(
    df: DataFrame, keys: Sequence[str], fold: str = "fold", y: str = "y", yhat: str = "yhat", score: str = "p",
    log2_slices: int = 9, weight: str | None = None,
) -> DataFrame:
    """Six metrics per key and fold; a row counts as often as ``weight`` says. A fold whose rows hold one class gets NaN on all six, and so
    does a fold whose model could not be fitted (its scores are NaN).

    The confusion counts ride along with the score counts, so one scan and one
    shuffle of the predictions serve all six.
    """
    by = [*keys, fold]
    t, p = F.col(y), F.col(yhat)
    totals = _ranked_totals(df, by, y, score, log2_slices, {
        "tp": F.when((t == 1) & (p == 1), 1).otherwise(0), "fp": F.when((t == 0) & (p == 1), 1).otherwise(0),
        "unscored": F.when(F.isnan(score), 1).otherwise(0),
    }, weight)
    counts = totals.withColumns({
        "fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp"), "n": F.col("_p") + F.col("_n"),
    })
    exprs = {**metric_columns(), "roc_auc": _auc_column()}
    one_class = (F.col("_p") == 0) | (F.col("_n") == 0) | (F.col("unscored") > 0)
    return counts.select(
        *by, *[F.when(one_class, F.lit(float("nan"))).otherwise(exprs[m]).alias(m) for m in CV_METRICS]
    )


def cv_summary(scores: DataFrame, keys: Sequence[str], fold: str = "fold") -> DataFrame:
    """Long table ``keys, metric, raw, mean``: scores in fold order and their mean (NaN if any fold is)."""
    long = scores.select(
        *keys, fold,
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in CV_METRICS
        ])).alias("_e"),
    ).select(*keys, fold, "_e.metric", "_e.value")
    return long.groupBy(*keys, "metric").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(fold, "value"))), lambda e: e["value"]).alias("raw"),
        F.avg("value").alias("mean"),
    )


def cv_wide(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One column per metric mean: ``accuracy, balanced_accuracy, f1, ...``."""
    return summary.groupBy(*keys).agg(*[
        F.max(F.when(F.col("metric") == m, F.col("mean"))).alias(m) for m in CV_METRICS
    ])


def prevalence(df: DataFrame, keys: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Positives and whole percent of positives per outcome, in one aggregate."""
    from cohortlens.functions.rounding import whole_percent

    aggs = []
    for o in outcomes:
        aggs += [F.sum(F.col(o).cast("long")).alias(f"{o}_n"), F.avg(o).alias(f"_{o}_share")]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)
    cols = [c for o in outcomes for c in (F.col(f"{o}_n"), whole_percent(f"_{o}_share").alias(f"{o}_pct"))]
    return out.select(*keys, "n", *cols)


def reliability_curve(
    df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "p", n_bins: int = 10
) -> DataFrame:
    """Mean score and share of positives per equal-width bin; empty bins have no row."""
    width = (1.0 + BIN_WIDENING) / n_bins
    bin_no = F.floor(F.col(score) / F.lit(width)).cast("int").alias("bin")
    return df.groupBy(*keys, bin_no).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean_score"),
        F.avg(F.col(y).cast("double")).alias("positive_share"),
    )


def highest(df: DataFrame, keys: Sequence[str], metrics: Sequence[str] = EVALUATION_METRICS) -> DataFrame:
    """Largest value over the named metric columns and rows, per key."""
    one = F.greatest(*[F.col(m) for m in metrics]) if len(metrics) > 1 else F.col(metrics[0])
    return df.groupBy(*keys).agg(F.max(one).alias("highest"))
