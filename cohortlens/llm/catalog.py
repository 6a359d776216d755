"""Queries of this package and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm.imatch import fingerprint_documents
from cohortlens.llm.licenses import scan_licenses
from cohortlens.llm.licenses_sql import licenses_sql
from cohortlens.llm.mixing import mix_sources
from cohortlens.llm.negatives import mine_negatives
from cohortlens.llm.negatives_sql import negatives_sql
from cohortlens.llm.neighbours import nearest_neighbours
from cohortlens.llm.ngrams import score_by_model
from cohortlens.llm.packing import plan_packing
from cohortlens.llm.pii import find_private
from cohortlens.llm.quality import score_quality
from cohortlens.llm.sharding import shuffle_to_shards
from cohortlens.llm.simhash import near_duplicates
from cohortlens.llm.tables import table
from cohortlens.llm.turns import repair_conversations
from cohortlens.llm.turns_sql import turns_sql
from cohortlens.llm.urls import judge_urls
from cohortlens.llm.urls_sql import urls_sql

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def query(run: Run) -> Run:
    QUERIES[run.__name__] = run
    return run


@query
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from the labels outside the held-out fifth."""
    scored = score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document and the component of near-duplicates it belongs to."""
    return near_duplicates(table(spark, folder, "documents"), width=3)


@query
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix by source weights takes from every document."""
    mixed = mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document by a bigram model and by its unigram base."""
    return score_by_model(table(spark, folder, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices in all documents."""
    return scan_licenses(table(spark, folder, "documents"))


@query
def op6_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return judge_urls(table(spark, folder, "pages")).withColumn("score", F.round("score", 9))


@query
def op7_imatch(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint_documents(table(spark, folder, "documents"))


@query
def op8_private(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    return find_private(table(spark, folder, "documents"))


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of 2,048 words that hold all documents."""
    return plan_packing(table(spark, folder, "documents"))


@query
def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest vectors of every twentieth one."""
    return nearest_neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document after a uniform shuffle into eight shards of equal row counts."""
    return shuffle_to_shards(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op12_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    return repair_conversations(table(spark, folder, "conversations"))


@query
def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with the labels of every seventh one changed."""
    return mine_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, F.col("vec_id") % 7 == 0)


ORACLE_SQL["op12_turns"] = turns_sql()
ORACLE_SQL["op13_negatives"] = negatives_sql()
ORACLE_SQL["op6_urls"] = urls_sql()
ORACLE_SQL["op3_licenses"] = licenses_sql()
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
