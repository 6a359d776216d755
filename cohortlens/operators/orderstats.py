"""Exact order statistics without sorting everything in one place.

All tools share one idea: count first, then look only at the few rows that can be
the answer. They work per key, so many groups are served by the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.subgroups import Registry, member_pattern, spread_pattern
from cohortlens.session import settled


def bucket_counts(
    df: DataFrame, keys: Sequence[str], order: str, prefix_chars: int, constant: Sequence[str] = ()
) -> DataFrame:
    """Rows per key and bucket: ``keys, _b, _n, _first`` and columns constant within a key.

    ``order`` is a text column of evenly spread hexadecimal digits (see ``order_key``),
    so its first characters cut the rows of a key into equal buckets. ``_first`` is the
    smallest key as a number (its first 60 bits): a minimum of text would make Spark
    sort the rows instead of hashing them.
    """
    number = F.conv(F.substring(order, 1, 15), 16, 10).cast("long")
    return df.groupBy(*keys, F.substring(order, 1, prefix_chars).alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(number).alias("_first"), *[F.max(c).alias(c) for c in constant])


def values_at_ranks(
    df: DataFrame, keys: Sequence[str], order: str, targets: Column, prefix_chars: int, hist: DataFrame,
    group_info: DataFrame | None = None,
) -> DataFrame:
    """Per key, the ``order`` text found at each 1-based rank of the array ``targets``.

    ``hist`` (:func:`bucket_counts`) says which bucket holds a wanted rank; only the
    rows of those buckets are numbered, all others are dropped where they are read.

    ``targets`` may use the columns of ``group_info`` (joined on ``keys``) and
    ``_total``, the number of rows of the key. Returns ``keys, rank, value``.
    """
    keyed = df.select(*keys, F.col(order).alias("_o"), F.substring(order, 1, prefix_chars).alias("_b"))
    part = [F.col(k) for k in keys] or [F.lit(1)]  # without keys: one row per bucket, not per row
    up_to = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*part)
    hist = hist.select(*keys, "_b", "_n")
    hist = hist.withColumn("_upto", F.sum("_n").over(up_to)).withColumn("_total", F.sum("_n").over(whole))
    if group_info is not None:
        hist = hist.join(group_info, list(keys))
    wanted = (
        hist.select(*keys, "_b", "_n", "_upto", F.explode(targets).alias("rank"))
        .where((F.col("rank") > F.col("_upto") - F.col("_n")) & (F.col("rank") <= F.col("_upto")))
        .select(*keys, "_b", F.col("rank").cast("long").alias("rank"),
                (F.col("rank") - F.col("_upto") + F.col("_n")).alias("_inside"))
        .groupBy(*keys, "_b").agg(F.collect_set(F.struct("_inside", "rank")).alias("_wanted"))
    )
    # one row per cut: fetched, so that all other rows are dropped without being shuffled
    wanted = settled(wanted)
    number = F.row_number().over(Window.partitionBy(*part, "_b").orderBy("_o"))
    return (
        keyed.join(wanted, [*keys, "_b"])
        .withColumn("_rn", number)
        .withColumn("_hit", F.explode(F.filter("_wanted", lambda w: w["_inside"] == F.col("_rn"))))
        .select(*keys, F.col("_hit.rank").alias("rank"), F.col("_o").alias("value"))
    )


def present(column: str) -> Column:
    """The value as a double; NaN counts as missing."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


#: bits of an ordered code that one pass over the rows decides
DIGIT_BITS = 16
_SIGN = np.int64(np.iinfo(np.int64).max)


def _flip(bits: np.ndarray) -> np.ndarray:
    """Between a double's bits and the whole number that orders like it; its own inverse."""
    return np.where(bits < 0, bits ^ _SIGN, bits)


def ordered_codes(df: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``keep`` and ``codes``, one 64-bit whole number per column that orders like the value; null and NaN give null."""
    rows = df.select(*keep, *[(present(c) + F.lit(0.0)).alias(f"_v_{i}") for i, c in enumerate(columns)])
    schema = T.StructType([*[rows.schema[c] for c in keep], *[T.StructField(f"_v_{i}", T.LongType()) for i in range(len(columns))]])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column(c) for c in keep]
            for i in range(len(columns)):
                v = batch.column(f"_v_{i}")
                bits = v.fill_null(0.0).to_numpy(zero_copy_only=False).view(np.int64)
                out.append(pa.array(_flip(bits), mask=v.is_null().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(encode, schema).select(*keep, F.array(*[f"_v_{i}" for i in range(len(columns))]).alias("codes"))


def _decoded(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, _c, _v``: the value of each code in ``code``."""
    rows = df.select(*keys, "_c", "rank", "code")
    schema = T.StructType([*[rows.schema[c] for c in (*keys, "_c", "rank")], T.StructField("_v", T.DoubleType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _flip(batch.column("code").to_numpy()).view(np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "_c", "rank")), pa.array(values)], names=schema.names)

    return rows.mapInArrow(decode, schema)


def _middle_values(codes: DataFrame, keys: Sequence[str], spread=None) -> DataFrame:
    """``keys, _c, rank, code``: the codes at both middle ranks of every key and column, by radix selection.

    ``codes`` has rows of ``cell`` columns and ``codes``; ``spread`` turns a table by cell into one by ``keys``
    (a cell is then a membership pattern), so that the first pass counts every row once.
    Each pass counts the next 16 bits of the codes that share the bits known so far; a key
    and column has at most 65,536 counters, and they are all that its task holds.
    """
    keys = list(keys)
    cell = [c for c in codes.columns if c != "codes"]
    spread = spread or (lambda df: df)
    long = codes.select(*cell, F.posexplode("codes").alias("_c", "code")).where(F.col("code").isNotNull())
    at = [*keys, "_c"]
    found: list[DataFrame] = []
    open_: DataFrame | None = None
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = F.shiftright("code", shift).alias("digit")
        if open_ is None:
            rows, by = long, []
        else:
            # only codes under a prefix that is still open; few, as the first bits tell most values apart
            above = F.shiftright("code", shift + DIGIT_BITS)
            prefixes = open_.select("_c", "prefix").distinct()
            rows, by = long.withColumn("prefix", above).join(prefixes, ["_c", "prefix"], "left_semi"), ["prefix"]
        cells = rows.groupBy(*cell, "_c", *by, digit).agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("low"), F.max("code").alias("high"))
        hist = spread(cells).groupBy(*at, *by, "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        run = Window.partitionBy(*at, *by)
        upto = F.sum("n").over(run.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        if open_ is None:
            total = hist.withColumn("upto", upto).withColumn("total", F.sum("n").over(run))
            ranks = F.array(F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1)
            wanted = total.select("*", F.posexplode(ranks).alias("rank", "_at"))
        else:
            same = [F.col(f"h.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*at, "prefix")]
            wanted = hist.withColumn("upto", upto).alias("h").join(open_.alias("o"), reduce(lambda a, b: a & b, same)).select(
                "h.*", "o.rank", F.col("o.inside").alias("_at"))
        hit = wanted.where((F.col("_at") > F.col("upto") - F.col("n")) & (F.col("_at") <= F.col("upto"))).select(
            *at, "rank", F.col("digit").alias("prefix"), (F.col("_at") - F.col("upto") + F.col("n")).alias("inside"), "low", "high")
        hit = settled(hit)
        # one value left under the prefix: it is the answer, whatever bits follow
        found.append(hit.where("low = high").select(*at, "rank", F.col("low").alias("code")))
        open_ = hit.where("low <> high").select(*at, "rank", "prefix", "inside")
        if open_.isEmpty():
            break
    return reduce(lambda a, b: a.unionByName(b), found)


def _as_columns(middle: DataFrame, keys: Sequence[str], columns: Sequence[str], every: DataFrame | None) -> DataFrame:
    values = _decoded(middle, keys)
    half = lambda i, r: F.max(F.when((F.col("_c") == i) & (F.col("rank") == r), F.col("_v")))
    medians = [((half(i, 0) + half(i, 1)) / 2).alias(c) for i, c in enumerate(columns)]
    if every is None:
        return values.agg(*medians)
    # keys without any value have no row among the codes
    nothing = every.select(*keys, F.lit(None).cast("int").alias("_c"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("_v"))
    return values.unionByName(nothing).groupBy(*keys).agg(*medians)


def exact_medians(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exact median of each column per key, ignoring nulls and NaN; null where all values are.

    ``F.median`` is exact too, but gathers every distinct value of a group in one task.
    Here values become ordered 64-bit codes and both middle ranks are found by radix
    selection, 16 bits a pass, all keys and columns together.
    """
    keys = list(keys)
    codes = ordered_codes(df, keys, columns)
    # codes are read by every pass; integers and short decimals need two
    codes = settled(codes, "codes")
    return _as_columns(_middle_values(codes, keys), keys, columns, codes.select(*keys).distinct() if keys else None)


def group_medians(df: DataFrame, columns: Sequence[str], registry: Registry, attributes: Sequence[str] | None = None) -> DataFrame:
    """Exact medians of everyone and of each subgroup: ``attribute, grp, ...``; a group without rows has none.

    Rows are counted per membership pattern, so none is copied for the groups it is in.
    """
    groups = registry.active(attributes)
    pattern = member_pattern(groups) if groups else F.lit("")
    codes = settled(ordered_codes(df.withColumn("_in", pattern), ["_in"], columns), "codes")
    keys = ["attribute", "grp"]
    spread = lambda t: spread_pattern(t, groups, "_in")
    return _as_columns(_middle_values(codes, keys, spread), keys, columns, spread(codes.select("_in").distinct()).distinct())
