"""From documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each
result as Parquet to the shared folder and gives it to the next stage, so a lost
executor never costs more than the stage it was lost in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.mixing import repeat_mixed
from cohortlens.llm.packing import packed_pieces
from cohortlens.llm.pii import mask_private
from cohortlens.llm.quality import keep_good
from cohortlens.llm.simhash import keep_one
from cohortlens.llm.tables import table
from cohortlens.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels of all but the held-out fifth."""
    return keep_good(docs, table(spark, sf_dir, "labels"), 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates."""
    return keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked."""
    return mask_private(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return repeat_mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the training sequence that each is part of."""
    return packed_pieces(docs).select("bin_id", "doc_id", "piece", "start", "n_words", "source", "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("private", private),
    ("mixture", mixture),
    ("packing", packing),
]

#: a classifier, a trained field and a packing have no SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*(F.col(c) for c in COLUMNS))
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
