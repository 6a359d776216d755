"""Recalibration of scores, fitted for many models at once.

Input is long: one row per held-out score with the keys of the model it came
from. One Spark job serves every model, instead of one fit per model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import local_table, settled

VARIANTS = ("raw", "sigmoid", "isotonic")


def score_counts(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """Positives and negatives per distinct score: all that either calibrator needs.

    The counts are whole numbers, so they are exact in any order of summation. Store the
    table and give it to both calibrators: the scored rows are then read once.
    """
    usable = df.where(~F.isnan(F.col(score).cast("double")))
    # 0.0 + x: minus zero is the same score as zero
    return usable.groupBy(*keys, (F.col(score).cast("double") + F.lit(0.0)).alias("_s")).agg(
        F.sum(F.col(y).cast("double")).alias("_pos"), F.sum(1 - F.col(y).cast("double")).alias("_neg")
    )


def _counted(df: DataFrame, keys: Sequence[str], score: str, y: str) -> DataFrame:
    """``df`` itself if it already holds score counts."""
    return df if {"_s", "_pos", "_neg"} <= set(df.columns) else score_counts(df, keys, score, y)


# --- sigmoid --------------------------------------------------------------

def fit_sigmoid(
    df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y", max_passes: int = 60, tol: float = 1e-9
) -> DataFrame:
    """Platt's sigmoid ``1 / (1 + exp(a * score + b))`` per key, with his smoothed targets.

    Newton's method for all keys together: a pass is one aggregate (loss, gradient
    and curvature per key), and only two numbers per key travel between passes. A
    step that does not lower the loss is halved. A key with one class keeps a = 0.
    ``df`` holds scored rows or their :func:`score_counts`.
    """
    keys = list(keys)
    spark = df.sparkSession
    counts = _counted(df, keys, score, y).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = counts.groupBy(*keys).agg(F.sum("_pos").alias("np"), F.sum("_neg").alias("nn")).collect()
        state = {}
        for r in sizes:
            state[tuple(r[k] for k in keys)] = {
                "hi": (r["np"] + 1) / (r["np"] + 2), "lo": 1 / (r["nn"] + 2),
                "ab": (0.0, math.log((r["nn"] + 1) / (r["np"] + 1))), "best": None,
                "loss": math.inf, "done": r["np"] == 0 or r["nn"] == 0,
            }
        schema = T.StructType(
            [f for f in counts.schema.fields if f.name in keys]
            + [T.StructField(c, T.DoubleType()) for c in ("_a", "_b", "_hi", "_lo")]
        )
        by_name = [f.name for f in schema.fields if f.name in keys]
        for _ in range(max_passes):
            open_keys = [k for k, v in state.items() if not v["done"]]
            if not open_keys:
                break
            params = local_table(spark, [
                tuple(dict(zip(keys, k))[c] for c in by_name) + state[k]["ab"] + (state[k]["hi"], state[k]["lo"])
                for k in open_keys], schema)
            for r in _sigmoid_pass(counts, params, keys).collect():
                _newton_step(state[tuple(r[k] for k in keys)], r, tol)
        out = [tuple(dict(zip(keys, k))[c] for c in by_name) + (v["best"] or v["ab"]) for k, v in state.items()]
        return local_table(spark, out, T.StructType(
            schema.fields[: len(by_name)] + [T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())]
        ))
    finally:
        counts.unpersist()


def _sigmoid_pass(counts: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    joined = counts.join(params, keys) if keys else counts.join(F.broadcast(params))  # one parameter row
    z = F.col("_a") * F.col("_s") + F.col("_b")
    p = 1 / (1 + F.exp(z))
    n = F.col("_pos") + F.col("_neg")
    target = F.col("_pos") * F.col("_hi") + F.col("_neg") * F.col("_lo")
    # -log p = log(1 + e^z) and -log(1 - p) = log(1 + e^-z), written so that e^z cannot overflow
    soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    d1 = target - n * p
    d2 = n * p * (1 - p)
    return joined.groupBy(*keys).agg(
        F.sum(target * soft + (n - target) * (soft - z)).alias("loss"),
        F.sum(d1 * F.col("_s")).alias("ga"), F.sum(d1).alias("gb"),
        F.sum(d2 * F.col("_s") * F.col("_s")).alias("haa"), F.sum(d2 * F.col("_s")).alias("hab"),
        F.sum(d2).alias("hbb"), F.sum(n).alias("n"),
    )


def _newton_step(s: dict, r, tol: float) -> None:
    """Accept or halve the last step of one key, then propose the next."""
    if r["loss"] > s["loss"] + 1e-12 * r["n"]:
        a, b = ((x + y) / 2 for x, y in zip(s["ab"], s["best"]))
        s["done"] = max(abs(a - s["best"][0]), abs(b - s["best"][1])) < 1e-12
        s["ab"] = (a, b)
        return
    gain = s["loss"] - r["loss"]
    s["best"], s["loss"] = s["ab"], r["loss"]
    if gain < tol * r["n"] * 1e-3 and max(abs(r["ga"]), abs(r["gb"])) < tol * r["n"]:
        s["done"] = True
        return
    ridge = 1e-12 * (r["haa"] + r["hbb"] + 1e-300)
    haa, hbb, hab = r["haa"] + ridge, r["hbb"] + ridge, r["hab"]
    det = haa * hbb - hab * hab
    if not det > 0:
        s["done"] = True
        return
    step_a, step_b = (hbb * r["ga"] - hab * r["gb"]) / det, (haa * r["gb"] - hab * r["ga"]) / det
    a, b = s["best"]
    s["ab"] = (a - step_a, b - step_b)
    if max(abs(step_a), abs(step_b)) < 1e-13:
        s["done"] = True


def apply_sigmoid(df: DataFrame, fitted: DataFrame, keys: Sequence[str], score: str = "score", out: str = "p") -> DataFrame:
    """Add the calibrated probability. Spark broadcasts the fitted table while it is small, else joins by key."""
    cols = df.columns
    joined = df.join(fitted, list(keys)) if keys else df.join(F.broadcast(fitted))  # one parameter row
    return joined.select(*cols, (1 / (1 + F.exp(F.col("a") * F.col(score) + F.col("b")))).alias(out))


# --- isotonic -------------------------------------------------------------

def _pool(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, s: np.ndarray):
    """Pool adjacent violators over blocks in score order; returns the remaining blocks."""
    L, H, W, S = [], [], [], []
    for a, b, wi, si in zip(lo, hi, w, s):
        while W and S[-1] * wi >= si * W[-1]:  # previous mean >= this mean
            a, wi, si = L.pop(), wi + W.pop(), si + S.pop()
            H.pop()
        L.append(a), H.append(b), W.append(wi), S.append(si)
    return L, H, W, S


def fit_isotonic(df: DataFrame, keys: Sequence[str], score: str = "score", y: str = "y") -> DataFrame:
    """Isotonic regression per key: ``keys, xs, ys`` (sorted thresholds and their values).

    Scores are ordered by a range shuffle on (keys, score), which also splits a key
    with many scores over tasks. Each task pools its own stretch while streaming
    over it; a second, per-key pass pools the blocks that are left. Pooling in two
    steps gives the same fit as pooling once, wherever the cuts fall. With 0/1
    labels, m scores leave at most order m**(2/3) blocks, so the second pass is small.
    ``df`` holds scored rows or their :func:`score_counts`.
    """
    keys = list(keys)
    counts = _counted(df, keys, score, y).select(
        *keys, F.col("_s").alias("lo"), F.col("_s").alias("hi"),
        (F.col("_pos") + F.col("_neg")).alias("w"), F.col("_pos").alias("s"),
    )
    ordered = counts.repartitionByRange(*[F.col(k) for k in keys], F.col("lo")).sortWithinPartitions(*keys, "lo")

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a stretch of one key may span batches: carry its blocks along
        carry: pd.DataFrame | None = None
        for batch in batches:
            if batch.empty:
                continue
            if carry is not None:
                batch = pd.concat([carry, batch], ignore_index=True)
            groups = list(batch.groupby(keys, sort=False, dropna=False)) if keys else [((), batch)]
            for i, (_, g) in enumerate(groups):
                L, H, W, S = _pool(g["lo"].to_numpy(), g["hi"].to_numpy(), g["w"].to_numpy(), g["s"].to_numpy())
                block = g.iloc[: len(L)].copy()
                block["lo"], block["hi"], block["w"], block["s"] = L, H, W, S
                if i + 1 < len(groups):
                    yield block
                else:
                    carry = block
        if carry is not None:
            yield carry

    key_fields = [f for f in counts.schema.fields if f.name in keys]
    out_schema = T.StructType(key_fields + [
        T.StructField("xs", T.ArrayType(T.DoubleType())), T.StructField("ys", T.ArrayType(T.DoubleType()))])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo")
        L, H, W, S = _pool(pdf["lo"].to_numpy(), pdf["hi"].to_numpy(), pdf["w"].to_numpy(), pdf["s"].to_numpy())
        xs: list[float] = []
        ys: list[float] = []
        for a, b, wi, si in zip(L, H, W, S):
            for x in (a,) if a == b else (a, b):
                xs.append(x), ys.append(si / wi)
        row = {f.name: [pdf[f.name].iloc[0]] for f in key_fields}
        return pd.DataFrame({**row, "xs": [xs], "ys": [ys]})

    blocks = ordered.mapInPandas(local, counts.schema)
    return settled(blocks.groupBy(*keys).applyInPandas(final, out_schema))


def thresholds_up_to(xs: Column, score: Column) -> Column:
    """How many of the sorted thresholds are <= score, by bisection; 31 steps reach the end of any array."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(31))])
    return F.aggregate(
        steps, F.lit(0),
        lambda at, h: F.when((at + h <= F.size(xs)) & (F.get(xs, at + h - 1) <= score), at + h).otherwise(at),
    )


def interpolate(i: Column, xs: Column, ys: Column, score: Column) -> Column:
    """Piecewise linear value at ``score``, which has ``i`` thresholds at or below it; flat outside."""
    n = F.size(xs)
    x0, x1, y0, y1 = F.get(xs, i - 1), F.get(xs, i), F.get(ys, i - 1), F.get(ys, i)
    return (
        F.when(i == 0, F.get(ys, F.lit(0))).when((i == n) | (x0 == score), y0)
        .otherwise(y0 + (y1 - y0) * (score - x0) / (x1 - x0))
    )


def apply_isotonic(df: DataFrame, fitted: DataFrame, keys: Sequence[str], score: str = "score", out: str = "p") -> DataFrame:
    """Add the calibrated probability."""
    cols = df.columns
    joined = df.join(fitted, list(keys)) if keys else df.join(F.broadcast(fitted))  # one fitted row
    s = F.col(score).cast("double")
    # the bisection gets a column of its own: it is used several times, but should run once
    return joined.withColumn("_i", thresholds_up_to(F.col("xs"), s)).select(
        *cols, interpolate(F.col("_i"), F.col("xs"), F.col("ys"), s).alias(out)
    )


# --- both -----------------------------------------------------------------

def calibrated_mean(df: DataFrame, keys: Sequence[str], p: str = "p") -> DataFrame:
    """Average the calibrated probabilities of a row's inner models, then classify."""
    mean = df.groupBy(*keys).agg(F.avg(p).alias("p"))
    return mean.withColumn("yhat", F.when(F.col("p") > 0.5, 1).otherwise(0))


def fit_calibrators(
    df: DataFrame, keys: Sequence[str], methods: Sequence[str] = ("sigmoid", "isotonic"), inner: str = "inner",
    n_inner: int = 2,
) -> DataFrame:
    """All calibrators of a model in one row: ``keys, a_0, b_0, xs_0, ys_0, a_1, ...``.

    ``df`` is long: ``keys, inner, score, y`` with held-out scores. It is read once, for
    the counts that all methods share.
    """
    parts = []
    counts = settled(score_counts(df, [*keys, inner]), "scores")
    for method in methods:
        if method == "sigmoid":
            fitted, columns = fit_sigmoid(counts, [*keys, inner]), ("a", "b")
        elif method == "isotonic":
            fitted, columns = fit_isotonic(counts, [*keys, inner]), ("xs", "ys")
        else:
            raise ValueError(f"unknown calibration {method!r}")
        parts.append(fitted.groupBy(*keys).agg(*[
            F.first(F.when(F.col(inner) == i, F.col(c)), ignorenulls=True).alias(f"{c}_{i}")
            for i in range(n_inner) for c in columns
        ]))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(keys))
    return settled(out)


def apply_calibrators(
    df: DataFrame, fitted: DataFrame, keys: Sequence[str], scores: Sequence[str],
    methods: Sequence[str] = ("sigmoid", "isotonic"),
) -> DataFrame:
    """Recalibrated predictions of rows that carry the scores of all inner models side by side.

    Adds ``calibration, p, yhat`` with the inner models averaged: a per-row
    expression, so nothing is grouped or shuffled. A NaN score, from a training
    part with one class, stays NaN.
    """
    cols = [c for c in df.columns if c not in scores]
    joined = df.join(fitted, list(keys))
    at = {}
    if "isotonic" in methods:
        at = {f"_i_{i}": thresholds_up_to(F.col(f"xs_{i}"), F.col(s)) for i, s in enumerate(scores)}
        joined = joined.withColumns(at)

    def one(method: str, i: int, s: str) -> Column:
        if method == "sigmoid":
            p = 1 / (1 + F.exp(F.col(f"a_{i}") * F.col(s) + F.col(f"b_{i}")))
        else:
            p = interpolate(F.col(f"_i_{i}"), F.col(f"xs_{i}"), F.col(f"ys_{i}"), F.col(s))
        return F.when(F.isnan(s), F.lit(float("nan"))).otherwise(p)

    entries = []
    for method in methods:
        p = sum((one(method, i, s) for i, s in enumerate(scores)), F.lit(0.0)) / len(scores)
        entries.append(F.struct(F.lit(method).alias("calibration"), p.alias("p")))
    out = joined.withColumn("_e", F.explode(F.array(*entries))).select(*cols, "_e.calibration", "_e.p")
    return out.withColumn("yhat", F.when((F.col("p") > 0.5) & ~F.isnan("p"), 1).otherwise(0))
