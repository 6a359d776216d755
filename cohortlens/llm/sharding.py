"""Shuffle rows into shards of exact size by a hypergeometric communication matrix.

1. Every input partition permutes its own rows (only id, size and checksum; the text
   is read once and goes no further).
2. How many rows partition ``p`` sends to shard ``s`` is drawn exactly as a uniform
   shuffle of all rows would have it: row ``p`` of the matrix is multivariate
   hypergeometric given the rows that shards still lack. Partitions are leaves of a
   tree with ``FAN`` children a node, so that a task draws for one node only and the
   matrix never passes through one place.
3. A partition's permuted rows are cut by its counts: the first go to shard 0, and so on.
4. Rows are exchanged by shard and stretch of slots.
5. A shard permutes what it received by a keyed permutation of its slots that a row
   computes on its own. So a shard may be of any size, and no task holds one.

All draws come from seeded generators named by node or partition: a repeated task
repeats its draws, and reruns over the same files agree.

Law ``rows``: shard sizes differ by at most one row, the first shards having one more.
Defined cases: a missing text has size 1 and checksum 0, like an empty one; missing ids
are kept; equal rows and equal texts are rows of their own, dealt like all others; an
empty table gives no rows; fewer rows than shards leave the last shards empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.text import mix, parts
from cohortlens.session import local_table, materialize

#: children of a node of the tree of partitions
FAN = 64
#: rows of a shard that are exchanged together, as a power of two
STRETCH_BITS = 14
#: rounds of the keyed permutation
ROUNDS = 6


def generator(seed: int, *name: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, *name])))


def draw_good(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` items drawn without replacement are good.

    By inversion: the probabilities of a stretch around the mode follow from the ratios
    of neighbours and are normalised by their sum, which needs no factorials and works
    for any population. Beyond 12 standard deviations lies less than 1e-30 of the mass.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    share = good / total
    deviation = (n * share * (1 - share) * (total - n) / max(total - 1, 1)) ** 0.5
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    reach = int(12 * deviation) + 40
    first, last = max(low, mode - reach), min(high, mode + reach)
    up = np.arange(mode, last, dtype=np.float64)
    up = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    down = np.arange(mode, first, -1, dtype=np.float64)
    down = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    mass = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
    return min(first + int(np.searchsorted(mass, rng.random() * mass[-1], "right")), last)


def draw_row(rng: np.random.Generator, lacking: np.ndarray, n: int) -> np.ndarray:
    """Rows that each shard gets out of ``n``, when shards still lack ``lacking`` rows in all."""
    out = np.zeros(len(lacking), np.int64)
    rest = int(lacking.sum())
    for s, want in enumerate(int(x) for x in lacking):
        if not n:
            break
        rest -= want
        out[s] = draw_good(rng, want, rest, n)
        n -= int(out[s])
    return out


def permuted_slots(places: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A permutation of 0 to size - 1, named by its key, applied to every place.

    Balanced Feistel rounds over the next even number of bits; a value that falls
    outside is put through again until it falls inside (less than four times on average).
    """
    half = np.array([max(1, (int(n - 1).bit_length() + 1) // 2) for n in np.unique(sizes)], np.uint64)
    half = half[np.searchsorted(np.unique(sizes), sizes)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = places.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, key = half[todo], mask[todo], keys[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right * np.uint64(0x9E3779B97F4A7C15) + key + np.uint64(r << 56)) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= sizes[todo].astype(np.uint64)]
    return out.astype(np.int64)


def permuted_rows(docs: DataFrame, id_column: str, text: str, seed: int) -> DataFrame:
    """Id, ``size``, ``text_crc32``, ``part`` and ``place``, the row's place after a shuffle inside its partition.

    A task keeps id, size and checksum of the rows of its own input split; texts pass by.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("size", T.LongType()), T.StructField("text_crc32", T.LongType()),
                           T.StructField("part", T.LongType()), T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, sizes, sums = [], [], []
        for batch in batches:
            texts = [(t.as_buffer() or b"") if t.is_valid else b"" for t in batch.column("text")]
            ids.append(batch.column("id"))
            sizes.append(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
            sums.append(np.fromiter((zlib.crc32(t) for t in texts), np.int64, len(texts)))
        if not ids:
            return
        n = sum(len(x) for x in ids)
        out = pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(sums)),
             pa.array(np.full(n, part, np.int64)), pa.array(generator(seed, 0, part).permutation(n))], names=schema.names)
        yield from parts([out], 1 << 16)

    return rows.mapInArrow(run, schema)


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _drawing(seed: int, depth: int):
    """Deal what a node's rows send, and where they begin in every shard, to its children in turn."""

    def draw(table: pa.Table) -> pa.Table:
        order = np.argsort(table["node"].to_numpy())
        nodes, rows = table["node"].to_numpy()[order], table["rows"].to_numpy()[order]
        lacking = np.array(table["sent"][0].as_py(), np.int64)
        first = np.array(table["first"][0].as_py(), np.int64)
        rng = generator(seed, 1, depth, int(nodes[0]) // FAN)
        sent, firsts = [], []
        for n in rows:
            sent.append(draw_row(rng, lacking, int(n)))
            firsts.append(first)
            lacking, first = lacking - sent[-1], first + sent[-1]
        lists = pa.list_(pa.int64())
        return pa.table({"node": nodes, "sent": pa.array([x.tolist() for x in sent], lists),
                         "first": pa.array([x.tolist() for x in firsts], lists)})

    return draw


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """``part``, ``sent`` and ``first`` per shard: rows that a partition sends, and its first place there.

    ``counts`` has ``part`` and ``rows``. Sums go up the tree of partitions, draws come down.
    """
    levels = [materialize(counts.select(F.col("part").alias("node"), F.col("rows").cast("long").alias("rows")), "parts")]
    top, total = levels[0].agg(F.max("node"), F.sum("rows")).first()
    top, total = top or 0, total or 0
    while top:
        top //= FAN
        levels.append(materialize(
            levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(F.sum("rows").alias("rows")), "nodes"))
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("sent", T.ArrayType(T.LongType())),
                           T.StructField("first", T.ArrayType(T.LongType()))])
    drawn = local_table(counts.sparkSession, [(0, shard_sizes(total, shards), [0] * shards)], schema)
    for depth in range(len(levels) - 2, -1, -1):
        above = drawn.withColumnRenamed("node", "parent")
        children = levels[depth].withColumn("parent", F.floor(F.col("node") / FAN)).join(above, "parent")
        drawn = materialize(children.groupBy("parent").applyInArrow(_drawing(seed, depth), schema), "matrix")
    return drawn.withColumnRenamed("node", "part")


def shuffle_to_shards(docs: DataFrame, *, shards: int = 8, seed: int = 11, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``size``, ``text_crc32``, ``shard`` and ``slot``, gapless from 0 in every shard.

    Rows come exchanged by shard and stretch of slots, in order of their slots. Size counts
    the text's UTF-8 bytes and one more.
    """
    rows = materialize(permuted_rows(docs, id_column, text, seed), "permuted")
    counts = materialize(rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "counts")
    matrix = communication_matrix(counts, shards, seed)
    sizes = np.array(shard_sizes(counts.agg(F.sum("rows")).first()[0] or 0, shards), np.int64)
    keys = generator(seed, 2).integers(0, 1 << 63, shards, dtype=np.uint64)
    schema = T.StructType([T.StructField(id_column, rows.schema["id"].dataType), T.StructField("size", T.LongType()),
                           T.StructField("text_crc32", T.LongType()), T.StructField("shard", T.IntegerType()),
                           T.StructField("slot", T.LongType())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1 << 14):
            if not batch.num_rows:
                continue
            place = batch.column("place").to_numpy()
            sent = batch.column("sent").flatten().to_numpy().reshape(-1, shards)
            first = batch.column("first").flatten().to_numpy().reshape(-1, shards)
            ends = np.cumsum(sent, axis=1)
            shard = (place[:, None] >= ends).sum(axis=1)
            at = np.arange(len(place))
            arrival = first[at, shard] + place - (ends - sent)[at, shard]
            slot = permuted_slots(arrival, sizes[shard], keys[shard])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("size"), batch.column("text_crc32"), pa.array(shard.astype(np.int32)),
                 pa.array(slot)], names=schema.names)

    # a partition's row of the matrix meets all its rows: Spark broadcasts it or splits large partitions
    dealt = rows.join(matrix, "part").mapInArrow(send, schema)
    return dealt.repartition("shard", F.shiftright("slot", STRETCH_BITS)).sortWithinPartitions("shard", "slot")


def write_shards(docs: DataFrame, path: str, *, shards: int = 8, seed: int = 11, id_column: str = "doc_id", text: str = "text") -> None:
    """Write the rows of ``docs`` (unique ids) to ``path``, one folder a shard, each in the order of its slots.

    Every file holds one stretch of slots; ``slot`` is kept beside the row's own columns.
    """
    plan = shuffle_to_shards(docs, shards=shards, seed=seed, id_column=id_column, text=text).select(id_column, "shard", "slot")
    clash = [c for c in docs.columns if c.lower() in ("shard", "slot")]
    joined = docs.drop(*clash).join(plan, docs[id_column].eqNullSafe(plan[id_column])).drop(plan[id_column])
    (joined.repartition("shard", F.shiftright("slot", STRETCH_BITS)).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
