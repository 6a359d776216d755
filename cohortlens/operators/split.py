"""Train/test split and stratified folds that do not depend on storage order.

Rows get a seeded permutation (``order_key``). The test part is the first share
of it; folds are consecutive blocks of each class along it. So only the keys at a
few ranks are needed, and every row is placed by comparing its own key to them:
wide rows are never shuffled or sorted.

``mode="hash"`` skips even the counting: part sizes are then right in expectation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.order import hash_share, order_key
from cohortlens.operators.orderstats import bucket_counts, values_at_ranks
from cohortlens.session import settled

TEST_SHARE = 0.33
SPLIT_SEED = 13
_HASH_PARTS = 1_000_000


def split_train_test(
    df: DataFrame, row_id: str = "row_id", test_share: float = TEST_SHARE, seed: int = SPLIT_SEED, mode: str = "exact"
) -> DataFrame:
    """Add ``is_test``. Exact mode puts ``ceil(test_share * n)`` rows into the test part."""
    if not 0 < test_share < 1:
        raise ValueError("test_share must lie between 0 and 1")
    if mode == "hash":
        return df.withColumn("is_test", hash_share(row_id, seed, _HASH_PARTS) < math.ceil(test_share * _HASH_PARTS))
    if mode != "exact":
        raise ValueError("mode is 'exact' or 'hash'")
    keyed = df.select(order_key(row_id, seed).alias("_o"))
    target = F.array(F.ceil(F.lit(test_share) * F.col("_total")).cast("long"))
    last = values_at_ranks(keyed, [], "_o", target, 4, bucket_counts(keyed, [], "_o", 4))
    row = last.first()  # one row; an empty frame has none
    return df.withColumn("is_test", order_key(row_id, seed) <= F.lit(row["value"] if row else ""))


#: 4096 buckets per key and class
_FOLD_PREFIX = 3


def fold_ends(
    df: DataFrame, label: str, k: int | str, keys: Sequence[str] = (), row_id: str = "row_id", seed: int = SPLIT_SEED,
    order: str | None = None,
) -> DataFrame:
    """Last order key of folds 0..k-2 per key and class: ``keys, label, ends, rows_up_to``.

    ``rows_up_to`` counts the rows of folds 0, 0..1, ..., all, so fold sizes need no extra pass.

    ``k`` is a number, or the name of a column that is constant within ``keys``;
    ``order`` names a column that already holds the order key.

    Fold sizes follow the usual stratified rule: deal the rows, sorted by class,
    round robin to the folds and count. Class sizes per fold then differ by at most
    one, and so do fold sizes. Classes are ordered by first appearance.
    """
    if not isinstance(k, str) and k < 2:
        raise ValueError("k must be at least 2")
    by = [*keys, label]
    folds = F.col(k) if isinstance(k, str) else F.lit(k)
    ordered = df.select(*by, (F.col(order) if order else order_key(row_id, seed)).alias("_o"), folds.alias("_k"))
    hist = bucket_counts(ordered, by, "_o", _FOLD_PREFIX, ["_k"])
    classes = hist.groupBy(*by).agg(F.sum("_n").alias("_nc"), F.min("_first").alias("_first"), F.max("_k").alias("_k"))
    earlier = (
        Window.partitionBy(*(list(keys) or [F.lit(1)])).orderBy("_first", label).rowsBetween(Window.unboundedPreceding, -1)
    )
    info = classes.select(*by, "_k", "_nc", F.coalesce(F.sum("_nc").over(earlier), F.lit(0)).alias("_start"))

    def dealt(position: Column, i: Column) -> Column:
        """How many of the positions 0..position-1 go to the first ``i`` folds."""
        return F.floor(position / F.col("_k")) * i + F.least(position % F.col("_k"), i)

    start, stop = F.col("_start"), F.col("_start") + F.col("_nc")
    targets = info.withColumn("_ends", F.transform(
        F.sequence(F.lit(1), F.col("_k") - 1), lambda i: (dealt(stop, i) - dealt(start, i)).cast("long")
    ))
    # an empty first fold of a tiny class ends before its first row: no rank to look up
    found = values_at_ranks(ordered, by, "_o", F.filter("_ends", lambda e: e > 0), _FOLD_PREFIX, hist,
                            targets.select(*by, "_ends"))
    by_rank = found.groupBy(*by).agg(F.map_from_entries(F.collect_set(F.struct("rank", "value"))).alias("_at"))
    return targets.join(by_rank, by, "left").select(
        *by, F.transform("_ends", lambda e: F.coalesce(F.try_element_at("_at", e), F.lit(""))).alias("ends"),
        F.concat("_ends", F.array(F.col("_nc").cast("long"))).alias("rows_up_to"),
    )


def stratified_folds(
    df: DataFrame, label: str, k: int | str, keys: Sequence[str] = (), row_id: str = "row_id",
    seed: int = SPLIT_SEED, fold: str = "fold", mode: str = "exact", order: str | None = None,
) -> DataFrame:
    """Add a fold number 0..k-1, stratified by ``label`` within ``keys``.

    Rows that were multiplied before (by group, by outcome) should carry their order key in ``order``.
    """
    if mode == "hash":
        return df.withColumn(fold, hash_share(row_id, seed + 1, k))
    if mode != "exact":
        raise ValueError("mode is 'exact' or 'hash'")
    ends = settled(fold_ends(df, label, k, keys, row_id, seed, order).drop("rows_up_to"))
    # the key is a column below the join, so that it is computed once per row and not once per comparison
    keyed = df.withColumn("_key", F.col(order) if order else order_key(row_id, seed))
    return (
        keyed.join(ends, [*keys, label])
        .withColumn(fold, F.size(F.filter("ends", lambda e: e < F.col("_key"))))
        .select(*df.columns, fold)
    )


def inner_folds(
    df: DataFrame, label: str, keys: Sequence[str] = (), outer: str | None = None, n_outer: int = 5,
    row_id: str = "row_id", seed: int = SPLIT_SEED, k: int = 2, mode: str = "exact",
) -> DataFrame:
    """Folds inside each training part, for fitting a calibrator on held-out scores.

    With ``outer``, a column of ``n_outer`` folds, a row appears once per training part
    it belongs to (all outer folds but its own), marked by ``held_out``; without, the
    whole frame is one part.
    """
    if outer is None:
        return stratified_folds(df, label, k, keys, row_id, seed, "inner", mode)
    parts = df.withColumn("held_out", F.explode(F.array(*[F.lit(f) for f in range(n_outer)])))
    parts = parts.where(F.col("held_out") != F.col(outer))
    return stratified_folds(parts, label, k, [*keys, "held_out"], row_id, seed, "inner", mode)
