"""Reading cohort tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.sources.csv import read_csv_text

#: name pattern of index columns that a table export leaves behind
EXPORT_INDEX = r"^Unnamed"
#: cells that stand for a missing value (fixed values)
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a",
           "nan", "null")
#: types a column may be inferred as, the narrowest first
_INFERRED = ("bigint", "double", "boolean")


def drop_matching(df: DataFrame, pattern: str = EXPORT_INDEX) -> DataFrame:
    """Drop columns whose name matches ``pattern``; touches the schema only."""
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def read_cohort(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str | None = None
) -> DataFrame:
    """Read a cohort from parquet or from CSV with a header.

    CSV cells may be quoted, with doubled quotes and line breaks inside; cells in
    ``MISSING`` are null. Columns of a ``schema`` are found by name, whatever their
    order and whatever else the file has; a cell that doesn't fit its type is an
    error. Without a schema types are inferred in one extra pass over the file.
    The format follows the file name unless ``fmt`` is given.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    if fmt == "csv":
        text = read_csv_text(spark, path)
        text = text.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in text.columns])
        text = drop_matching(text, EXPORT_INDEX + r"|^_c0$")
        types = _inferred(text) if schema is None else _fields(schema)
        return text.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])
    if fmt == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return drop_matching(reader.parquet(path))
    raise ValueError(f"unknown cohort format {fmt!r}")


def _fields(schema: T.StructType | str) -> dict[str, T.DataType]:
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return {f.name: f.dataType for f in schema.fields}


def _inferred(text: DataFrame) -> dict[str, str]:
    """For each column the first type that all its values fit, else text; a column without values is text."""
    fits = text.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull()).alias(f"{i}_{t}")
                      for i, c in enumerate(text.columns) for t in _INFERRED],
                    *[F.count(F.col(f"`{c}`")).alias(f"{i}_n") for i, c in enumerate(text.columns)]).first()
    return {c: next((t for t in _INFERRED if fits[f"{i}_n"] and not fits[f"{i}_{t}"]), "string") for i, c in enumerate(text.columns)}


def read_split(df: DataFrame, part: str) -> DataFrame:
    """The ``train`` or ``test`` rows of a table with an ``is_test`` column."""
    if part not in ("train", "test"):
        raise ValueError("part is 'train' or 'test'")
    return df.where("is_test" if part == "test" else "not is_test").drop("is_test")
