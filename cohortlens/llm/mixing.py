"""Mix sources to target weights with hash-threshold histograms.

Every document gets a 60-bit hash of its id and text. A source takes each of its
documents as often as its target holds its size, and those with the smallest
hashes once more until the rest of the target is used up. The threshold is found
from histograms: words are summed by source and hash bucket, a running sum finds
the bucket in which the budget runs out, and only that bucket is summed again by
the next 12 bits, until it holds one hash. Documents are then filtered by their
hash; nothing is sorted. Thresholds of smaller budgets are nested in those of
larger ones, so raising a target only adds documents.

Targets: weights 5, 2, 1, 5, ... by code point order of the sources (a missing
source last) share all words. A target stops at ``ceiling`` times its source's
size; what is above is shared again by weight until none is above.

Defined cases: a missing text has size 0; documents of size 0 are taken with 0
words; repeated rows (same id and text) share a hash and are taken alike; the
document at the threshold is taken if that ends nearer to the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.tables import batches_of, free_name
from cohortlens.llm.text import count_words, hash_texts, mix, parts
from cohortlens.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
CEILING = 3
#: bits of the hash, and of one level of histograms
HASH_BITS, LEVEL_BITS = 60, 12


def measure(docs: DataFrame, id_column: str, text: str, source: str) -> DataFrame:
    """Replace the text by ``size`` (words) and ``hash`` (of id and text)."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"),
                       F.xxhash64(F.col(id_column)).alias("salt"))
    schema = T.StructType([rows.schema["id"], rows.schema["source"], T.StructField("size", T.LongType()),
                           T.StructField("hash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column("text")
            salt = batch.column("salt").to_numpy().view(np.uint64)
            h = mix(hash_texts(texts) ^ mix(salt)) >> np.uint64(64 - HASH_BITS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("source"), pa.array(count_words(texts)), pa.array(h.astype(np.int64))],
                names=["id", "source", "size", "hash"])

    return rows.mapInArrow(run, schema)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from rows of ``source`` and ``size``.

    Sources are numbered in order across range partitions, so there may be any number of them.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ordered = totals.orderBy(F.col("source").asc_nulls_last())
    schema = T.StructType([*totals.schema.fields, T.StructField("place", T.LongType())])
    numbered = totals.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = materialize(numbered.select("source", "source_size", turn.alias("weight")), "weights")
    most = F.col("source_size") * float(ceiling)
    level = None
    capped = F.lit(False)
    while True:
        # sources above their ceiling stop there; the others share what is left
        left = weighed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(capped, most).otherwise(0.0)).alias("taken"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not left["open"]:
            break
        new = (left["all"] - left["taken"]) / left["open"]
        if new == level:
            break
        level = new
        capped = F.col("weight") * F.lit(level) >= most
    share = most if level is None else F.when(capped, most).otherwise(F.col("weight") * F.lit(level))
    return weighed.select("source", "source_size", share.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``, ``copies`` and ``bound``: hashes below ``bound`` are taken once more than ``copies`` times."""
    same = lambda x, y: x["source"].eqNullSafe(y["source"])
    open_ = targets.where("source_size > 0").select(
        "source", F.floor(F.col("target") / F.col("source_size")).alias("copies"),
        (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).alias("budget"),
        F.lit(0).cast("long").alias("prefix"))
    open_ = materialize(open_, "budgets")
    done: list[DataFrame] = []
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        digit = F.shiftright("hash", shift).alias("bucket")
        inside = rows if shift == HASH_BITS - LEVEL_BITS else rows.alias("r").join(
            open_.select("source", "prefix").alias("o"),
            F.col("r.source").eqNullSafe(F.col("o.source")) & (F.shiftright("r.hash", shift + LEVEL_BITS) == F.col("o.prefix"))
        ).select("r.*")
        cells = inside.where("size > 0").groupBy("source", digit).agg(
            F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        # at most 4,096 cells of each source
        run = Window.partitionBy("source").orderBy("bucket")
        cells = cells.withColumn("upto", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        cells = cells.alias("c").join(open_.alias("o"), F.col("c.source").eqNullSafe(F.col("o.source"))).where(
            F.col("c.upto") - F.col("c.size") <= F.col("o.budget")).select("c.*", "o.copies", "o.budget")
        best = cells.groupBy("source", "copies", "budget").agg(
            F.max_by(F.struct("bucket", "low", "high", "size", "upto"), "bucket").alias("x")).select(
            "source", "copies", "x.*", (F.col("budget") - F.col("x.upto") + F.col("x.size")).alias("budget"))
        best = materialize(best, "boundary")
        # one hash, or a bucket that the budget covers: the threshold is known
        single = F.col("low") == F.col("high")
        take = F.when(F.col("budget") >= F.col("size") / 2, F.col("high") + 1).otherwise(F.col("low"))
        covered = F.col("budget") >= F.col("size")
        done.append(best.where(single | covered).select("source", "copies", F.when(covered, F.col("high") + 1).otherwise(take).alias("bound")))
        open_ = best.where(~single & ~covered).select("source", "copies", "budget", F.col("bucket").alias("prefix"))
        if open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix_sources(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", source: str = "source",
                weights: tuple[float, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """Per row: id, ``size``, ``source_size``, ``target``, ``taken`` words and ``copies``, how often it is taken."""
    rows = materialize(measure(docs, id_column, text, source), "sizes")
    targets = materialize(source_targets(rows, weights, ceiling), "targets")
    plan = targets.alias("t").join(thresholds(rows, targets).alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")), "left").select(
        "t.source", "t.source_size", "t.target", "b.copies", "b.bound")
    plan = materialize(plan, "plan")
    copies = F.coalesce(F.col("p.copies"), F.lit(0)) + F.when(F.col("r.hash") < F.col("p.bound"), 1).otherwise(0)
    return rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select(
        F.col("r.id").alias(id_column), F.col("r.size").alias("size"), F.col("p.source_size").alias("source_size"),
        F.col("p.target").alias("target"), (F.col("r.size") * copies).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def repeat_mixed(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Texts pass through a worker once, a few at a time, and are stored with their hash and size. How often a row is
    taken follows from its own source and hash, so texts are neither moved nor joined by id.
    """
    size, key, weight, number = (free_name(docs, f"mixing_{x}") for x in ("size", "hash", "plan", "turn"))
    schema = T.StructType([*docs.schema.fields, T.StructField(size, T.LongType()), T.StructField(key, T.LongType())])
    salted = docs.withColumn(weight, F.xxhash64(F.col(id_column)))
    names = docs.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(text)
            h = mix(hash_texts(texts) ^ mix(batch.column(weight).to_numpy().view(np.uint64))) >> np.uint64(64 - HASH_BITS)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(count_words(texts)), pa.array(h.astype(np.int64))], names=[*names, size, key])

    with batches_of(docs.sparkSession, 512):
        marked = materialize(salted.mapInArrow(mark, schema), "marked")
    measured = marked.select(F.col(source).alias("source"), F.col(size).alias("size"), F.col(key).alias("hash"))
    targets = materialize(source_targets(measured, **settings), "targets")
    plan = materialize(targets.select("source").join(thresholds(measured, targets).withColumnRenamed("source", "s"),
                                                     F.col("source").eqNullSafe(F.col("s"))).select("source", "copies", "bound"), "plan")
    copies = free_name(docs, "mixing_copies")
    named = plan.select(F.col("source").alias(weight), F.col("copies").alias(copies), F.col("bound").alias(number))
    taken = F.coalesce(F.col(copies), F.lit(0)) + F.when(F.col(key) < F.col(number), 1).otherwise(0)
    joined = marked.join(named, F.col(source).eqNullSafe(F.col(weight)))
    return joined.withColumn(number, F.explode(F.array_repeat(F.lit(1), taken.cast("int")))).select(*names)
