"""Connected components of a link table by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
            .union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root``: the smallest node that each linked node reaches. Nodes without a link are not listed.

    Self-links and missing ends are ignored. Rounds grow with the logarithm of a
    component's width. Each round is written to the shared folder, so a lost
    executor costs a re-read. Hot nodes: minima are combined before the shuffle,
    and the joins back are ordinary ones whose large partitions Spark splits.
    """
    edges = materialize(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    before = _signature(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges)), "stars")
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
