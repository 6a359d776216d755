"""Mine hard negatives with exact integer scores from a residue-number-system matrix product.

Components become integers (``floor(256 * x)``). Their residues modulo several small
primes are multiplied as float32 matrices, over so few components at a time that every
sum stays below 2**24 and is exact; the sums modulo the primes are joined by Chinese
remaindering (mixed radix) into the signed inner product. As many primes are taken as the
largest norms in the table need (one aggregate), so no score can wrap.

Anchors meet all rows in a grid: rows are dealt to cells of about ``CELL_VALUES`` components,
anchors to cells of about an eighth of it, by a hash of their place in the table, so equal
vectors or labels don't gather anywhere. A cell gives each anchor its best same-label rows;
one ranked merge leaves the positives. A second pass over the grid gives each anchor and
positive the best rows of other labels inside the score window, and a second merge ranks
them. A cell keeps at most the asked number per anchor, the rest of which can't be in the
result; all rows are scored.

Defined cases: rows without label or vector, or with a missing or non-finite component, take
no part; only vectors of equal width are compared (an empty one scores 0); equal rows are
rows of their own, and a row isn't its own positive; a missing id is never an anchor and
comes last among ties; positives of negative score have an empty window; scores beyond 64
bits are ranked exactly and given as null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import materialize

#: components of a cell's rows: 32,768 rows of 64
CELL_VALUES = 1 << 21
#: anchors whose scores a task holds at once
STRIP = 128
#: float32 sums of whole numbers are exact below this
EXACT = 1 << 24
MISSING_ID = np.iinfo(np.int64).max


@lru_cache(maxsize=16)
def primes_for(bound: int) -> tuple[int, ...]:
    """Odd primes whose product exceeds ``2 * bound + 1``: from 509 down to 3, then from 521 up."""
    found: list[int] = []
    product = 1
    for p in (*range(511, 2, -2), *range(513, 8192, 2)):
        if product > 2 * bound + 1:
            break
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            product *= p
    return tuple(found)


def residues(vectors: np.ndarray, prime: int) -> np.ndarray:
    """``floor(256 * x)`` modulo ``prime``, between -(p - 1) / 2 and (p - 1) / 2, exact for any finite double."""
    # doubles from 2**53 on are whole, and 256 times the largest would overflow
    large = np.abs(vectors) >= 2.0**53
    whole = np.fmod(np.where(large, np.fmod(vectors, prime) * 256.0, np.floor(np.where(large, 0.0, vectors) * 256.0)), prime)
    half = prime // 2
    whole = np.where(whole > half, whole - prime, whole)
    return np.where(whole < -half, whole + prime, whole).astype(np.float32)


def modular_product(a: np.ndarray, b: np.ndarray, prime: int) -> np.ndarray:
    """``a @ b.T`` modulo ``prime`` (0 to p - 1) of float32 residues."""
    total = np.zeros((len(a), len(b)), np.float32)
    # so many products of two residues, and what was left before, stay exact
    chunk = (EXACT - prime) // (prime // 2) ** 2
    for at in range(0, a.shape[1], chunk):
        total = np.fmod(total + a[:, at : at + chunk] @ b[:, at : at + chunk].T, np.float32(prime))
    return np.where(total < 0, total + np.float32(prime), total).astype(np.int64)


def signed_scores(parts: Iterator[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The integers nearest 0 with these residues; 64-bit if all fit, else Python integers."""
    whole = prod(primes)
    wide = np.int64 if whole < 1 << 62 else object
    value, radix = None, 1
    for p, part in zip(primes, parts, strict=True):
        if value is None:
            value = part.astype(wide)
        else:
            # the next mixed-radix digit makes the value right modulo p
            digit = (part - (value % p).astype(np.int64)) * pow(radix, -1, p) % p
            value = value + digit.astype(wide) * radix
        radix *= p
    return np.where(value > whole // 2, value - whole, value)


def score_strip(anchors: list[np.ndarray], rows: list[np.ndarray], primes: tuple[int, ...], strip: slice) -> np.ndarray:
    """Scores of a strip of anchors with all rows of a cell, from both sides' residues by prime."""
    return signed_scores((modular_product(a[strip], b, p) for a, b, p in zip(anchors, rows, primes, strict=True)), primes)


def best_places(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` largest scores, ties to the smaller place, in that order."""
    if len(scores) > most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        places = np.concatenate([above, level[: most - len(above)]])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((places, -scores[places]))] if scores.dtype != object else np.array(
        sorted(places.tolist(), key=lambda i: (-scores[i], i)), np.int64)


def _key(score: int, width: int) -> bytes:
    """Bytes that sort as the integers do."""
    return (int(score) + (1 << 8 * width - 1)).to_bytes(width, "big")


def _score(key: bytes) -> int:
    return int.from_bytes(key, "big") - (1 << 8 * len(key) - 1)


def usable_rows(rows: DataFrame, id_column: str, vector: str, label: str, is_anchor: Column, changed: Column, labels: int) -> DataFrame:
    """Rows that take part: ``row`` (own number), ``id``, ``label`` (after the change), ``vector``, ``anchor``."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = F.col(label).cast("long")
    return rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).where(finite).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"),
        F.when(F.coalesce(changed, F.lit(False)), (kept + 1) % labels).otherwise(kept).alias("label"),
        F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))


def _cell(table: pa.Table, width: int) -> tuple[np.ndarray, pa.Table]:
    """The vectors and the table, in order of id and row (missing ids last)."""
    ids = table["id"].combine_chunks().fill_null(MISSING_ID).to_numpy()
    order = np.lexsort((table["row"].to_numpy(), ids))
    vectors = table["vector"].combine_chunks()
    flat = vectors.flatten().to_numpy().reshape(len(table), width)[order]
    return flat, table.drop_columns(["vector"]).take(pa.array(order))


class Grid:
    """All cells in which anchors meet rows."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (F.abs(x) * 256 + 1) * (F.abs(x) * 256 + 1))
        # norms as doubles could overflow to infinity; then the largest component and the width bound the score
        n, anchors, norm2, widest, largest = rows.agg(
            F.count(F.lit(1)), F.sum(F.col("anchor").cast("long")), F.max(norm), F.max(F.size("vector")),
            F.max(F.array_max(F.transform("vector", F.abs)))).first()
        self.row_cells = max(1, -(-n * (widest or 1) // CELL_VALUES))
        self.anchor_cells = max(1, -(-(anchors or 0) * (widest or 1) * 8 // CELL_VALUES))
        if norm2 is not None and norm2 < 1e300:
            bound = int(norm2 * 1.000001) + 1
        else:
            bound = (widest or 0) * (int(largest or 0.0) * 256 + 1) ** 2
        self.primes = primes_for(bound)
        # bytes of a score, sign included
        self.width = bound.bit_length() // 8 + 1

    def _dealt(self, rows: DataFrame, own: str, own_cells: int, other: str, other_cells: int) -> DataFrame:
        """Every row once per cell of the other side."""
        return rows.withColumn("width", F.size("vector")).withColumn(own, F.pmod(F.xxhash64("row"), F.lit(own_cells))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_cells - 1).cast("long"))))

    def meet(self, anchors: DataFrame, function, schema: T.StructType) -> DataFrame:
        """``function(anchors, rows)`` of every cell of the grid, by Arrow tables."""
        key = ["width", "anchor_cell", "row_cell"]
        left = self._dealt(anchors, "anchor_cell", self.anchor_cells, "row_cell", self.row_cells)
        right = self._dealt(self.rows.select("row", "id", "label", "vector"), "row_cell", self.row_cells, "anchor_cell", self.anchor_cells)
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(function, schema)


def positives(grid: Grid, most: int) -> DataFrame:
    """``anchor`` (row number), ``positive_id`` and ``key``, the score as bytes: the best other rows of the anchor's label."""
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("row", T.LongType()),
                           T.StructField("id", T.LongType()), T.StructField("key", T.BinaryType())])
    primes, width = grid.primes, grid.width

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(anchors) and len(rows):
            size = anchors["width"][0].as_py()
            (a, anchors), (b, rows) = _cell(anchors, size), _cell(rows, size)
            left, right = [residues(a, p) for p in primes], [residues(b, p) for p in primes]
            number, labels = rows["row"].to_numpy(), rows["label"].to_numpy()
            ids = rows["id"].to_pylist()
            members = {label: np.flatnonzero(labels == label) for label in np.unique(labels).tolist()}
            for at in range(0, len(a), STRIP):
                scores = score_strip(left, right, primes, slice(at, at + STRIP))
                for i, own in enumerate(anchors["row"].to_numpy()[at : at + STRIP].tolist()):
                    same = members.get(anchors["label"][at + i].as_py(), np.zeros(0, np.int64))
                    same = same[number[same] != own]
                    for place in same[best_places(scores[i][same], most)].tolist():
                        out.append((own, int(number[place]), ids[place], _key(scores[i][place], width)))
        return _table(out, schema.names)

    found = grid.meet(grid.rows.where("anchor").select("row", "id", "label", "vector"), find, schema)
    best = Window.partitionBy("anchor").orderBy(F.col("key").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select(
        "anchor", "place", F.col("id").alias("positive_id"), "key")


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    types = {"key": pa.binary(), "positive_key": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table({n: pa.array(c, types.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)})


def negatives(grid: Grid, chosen: DataFrame, most: int, low: int, high: int) -> DataFrame:
    """``anchor``, ``place`` of the positive, ``row``, ``id`` and ``key`` of the best rows of other labels in the window."""
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("place", T.LongType()), T.StructField("row", T.LongType()),
                           T.StructField("id", T.LongType()), T.StructField("key", T.BinaryType())])
    primes, width = grid.primes, grid.width

    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(anchors) and len(rows):
            size = anchors["width"][0].as_py()
            (a, anchors), (b, rows) = _cell(anchors, size), _cell(rows, size)
            left, right = [residues(a, p) for p in primes], [residues(b, p) for p in primes]
            number, labels, ids = rows["row"].to_numpy(), rows["label"].to_numpy(), rows["id"].to_pylist()
            others = {label: np.flatnonzero(labels != label) for label in set(anchors["label"].to_pylist())}
            wanted = anchors["positives"].to_pylist()
            for at in range(0, len(a), STRIP):
                scores = score_strip(left, right, primes, slice(at, at + STRIP))
                for i, own in enumerate(anchors["row"].to_numpy()[at : at + STRIP].tolist()):
                    other = others[anchors["label"][at + i].as_py()]
                    mine = scores[i][other]
                    for positive in wanted[at + i]:
                        score = _score(positive["key"])
                        # 100 * s between low and high times the positive's score, in whole numbers
                        inside = np.flatnonzero((mine >= -(-low * score // 100)) & (mine <= high * score // 100))
                        for place in other[inside[best_places(mine[inside], most)]].tolist():
                            out.append((own, positive["place"], int(number[place]), ids[place], _key(scores[i][place], width)))
        return _table(out, schema.names)

    lists = chosen.groupBy("anchor").agg(F.collect_list(F.struct("place", "key")).alias("positives"))
    anchors = grid.rows.where("anchor").select("row", "id", "label", "vector").join(
        lists.withColumnRenamed("anchor", "row"), "row")
    return grid.meet(materialize(anchors, "anchors"), find, schema)


def _as_long(key: Column, width: int) -> Column:
    """The score of a key; null if it needs more than 64 bits."""
    digits = F.hex(key)
    offset = F.conv(digits, 16, 10).cast("decimal(38,0)") if width <= 8 else None
    if offset is not None:
        return (offset - F.lit(str(1 << 8 * width - 1)).cast("decimal(38,0)")).cast("long")
    # inside 64 bits all bytes above the lowest eight say the same as the sign
    extra = 2 * (width - 8)
    top = F.substring(digits, 1, extra)
    low = F.conv(F.substring(digits, extra + 1, 16), 16, 10).cast("decimal(38,0)")
    small = F.lit(str(1 << 63)).cast("decimal(38,0)")
    whole = F.lit(str(1 << 64)).cast("decimal(38,0)")
    return F.when((top == F.lit("80" + "00" * (width - 9))) & (low < small), low.cast("long")).when(
        (top == F.lit("7F" + "FF" * (width - 9))) & (low >= small), (low - whole).cast("long"))


def mine_negatives(rows: DataFrame, is_anchor: Column, changed: Column, *, id_column: str = "vec_id", vector: str = "embedding",
                   label: str = "label", labels: int = 10, most_positives: int = 5, most_negatives: int = 10,
                   low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    Anchors are the rows where ``is_anchor`` holds; where ``changed`` holds, the label first
    moves on by one of ``labels``. Negatives have between ``low`` and ``high`` percent of the positive's score.
    """
    usable = materialize(usable_rows(rows, id_column, vector, label, is_anchor, changed, labels), "vectors")
    grid = Grid(usable)
    chosen = materialize(positives(grid, most_positives), "positives")
    best = Window.partitionBy("anchor", "place").orderBy(F.col("key").desc(), F.col("id").asc_nulls_last(), "row")
    ranked = negatives(grid, chosen, most_negatives, low, high).withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= most_negatives).alias("n")
    named = usable.where("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return ranked.join(chosen.alias("p"), (F.col("n.anchor") == F.col("p.anchor")) & (F.col("n.place") == F.col("p.place"))).join(
        named.alias("a"), F.col("n.anchor") == F.col("a.anchor")).select(
        "a.anchor_id", "p.positive_id", F.col("n.rank").cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
        _as_long(F.col("p.key"), grid.width).alias("positive_score"), _as_long(F.col("n.key"), grid.width).alias("negative_score"))
