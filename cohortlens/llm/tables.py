"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries planned inside send workers at most ``rows`` rows at once: bounds the texts held on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def row_bits(rows: DataFrame, number: str) -> DataFrame:
    """``bucket``, ``bits``: a set of row numbers as one bitmap for every 32,768 numbers, an eighth of a byte a row."""
    return rows.groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def rows_of_bits(df: DataFrame, number: str, bits: DataFrame) -> DataFrame:
    """Rows of ``df`` whose number is set in ``bits``, of :func:`row_bits`.

    The bitmaps of a written table are small enough to be broadcast long after a list of numbers
    isn't; beyond Spark's threshold both sides are shuffled by bucket, none of which exceeds 32,768 rows.
    """
    held, bucket = free_name(df, "row_bits"), free_name(df, "row_bucket")
    place = F.bitmap_bit_position(F.col(number))
    byte = F.conv(F.hex(F.substring(F.col(held), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, (place % 8).cast("int"))
    return df.join(bits.select(F.col("bits").alias(held), F.col("bucket").alias(bucket)),
                   (F.bitmap_bucket_number(F.col(number)) == F.col(bucket)) & (bit == 1), "left_semi")


def id_share(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a missing id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts
