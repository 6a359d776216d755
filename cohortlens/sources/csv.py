"""CSV of any size: every split of a file is a task of its own, quoted line breaks included.

Lines are read as text, which Spark splits anywhere. A line break ends a record where an even
number of quotes stands before it in the file. So quotes are counted per split, their running sum
per file says whether a split begins inside quotes, and each task then joins its own lines to
records. What a record leaves in several splits, at most two pieces a split, is put together after.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPTIONS = {"escape": '"', "mode": "FAILFAST", "multiLine": "true"}
#: a piece that goes on a record of an earlier split, a whole record, a piece that goes on in the next split
_REST, _WHOLE, _BEGUN = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of each split, in their order, as records and pieces."""
    split, inside, place, held, first = None, 0, _WHOLE, [], False
    out: list[tuple[str, int, int, bool, str]] = []

    def left_over() -> None:
        if held:
            # a split without an even place in it is a piece in the middle
            out.append((*split, _REST if place == _REST else _BEGUN, first, "\n".join(held)))

    for batch in batches:
        files, starts, values = (batch.column(c).to_pylist() for c in ("file", "start", "value"))
        odd, opened = batch.column("quotes").to_numpy() % 2, batch.column("inside").to_numpy()
        for file, start, value, flips, carried in zip(files, starts, values, odd, opened, strict=True):
            if (file, start) != split:
                left_over()
                split, inside, held, first = (file, start), int(carried), [], start == 0
                place = _REST if inside else _WHOLE
            if not inside and value in ("", "\r"):
                continue
            held.append(value)
            inside ^= int(flips)
            if not inside:
                out.append((file, start, place, first, "\n".join(held)))
                place, held, first = _WHOLE, [], False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["file", "start", "place", "first", "record"])
            out.clear()
    left_over()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["file", "start", "place", "first", "record"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``record`` and ``first`` (is it its file's first one) of all CSV files at ``path``; empty lines are left out.

    Quotes must follow RFC 4180: a cell with a quote in it is quoted and the quote doubled.
    """
    lines = _lines(spark, path)
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # one row of about 100 bytes for each split, so a broadcast of a millionth of the files; it keeps lines in order
    opened = lines.groupBy("file", "start").agg((F.sum("quotes") % 2).alias("odd")).select(
        "file", "start", (F.coalesce(F.sum("odd").over(order), F.lit(0)) % 2).cast("int").alias("inside"))
    pieces = lines.join(F.broadcast(opened), ["file", "start"]).select("file", "start", "value", "quotes", "inside").mapInArrow(
        _joined, "file string, start long, place long, first boolean, record string")
    along = Window.partitionBy("file").orderBy("start", "place")
    broken = pieces.where(F.col("place") != _WHOLE).withColumn("group", F.count_if(F.col("place") == _BEGUN).over(along))
    mended = broken.groupBy("file", "group").agg(
        F.array_sort(F.collect_list(F.struct("start", "place", "record"))).alias("p"), F.bool_or("first").alias("first")).select(
        "first", F.array_join("p.record", "\n").alias("record"))
    whole = pieces.where(F.col("place") == _WHOLE).select("first", "record").unionByName(mended)
    return whole.withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> ''")


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All cells of CSV files with a header, as text."""
    # reads the first record only
    names = spark.read.options(header=True, inferSchema=False, **OPTIONS).csv(path).schema
    rows = csv_records(spark, path).where(~F.col("first"))
    ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in names.names)
    return rows.select(F.from_csv("record", ddl, OPTIONS).alias("cells")).select("cells.*")
