"""Best-fit packing of documents into sequences under conflicts.

A bin holds ``capacity`` words. It never holds two documents of one duplicate
cluster, nor more than ``source_limit`` of one source, so that a sequence mixes its
sources and repeats nothing. Documents longer than a bin are cut: whole bins of
their own first, then the rest is packed like a short document.

Rows are dealt at random to shards of about ``shard_rows`` rows, each packed by one
task, largest documents first. Bins are kept by residual space. A bitmap of
residuals in use gives the smallest one that a document fits (its successor); bins
with that residual are tried by their source and cluster bitmaps, and the search
goes on to the next residual until a bin agrees. That is the tightest compatible
bin. If there is none, a new bin is opened. A shard leaves a few bins part empty,
whatever the number of shards. Shards are dealt by row and not by source, cluster
or text, so a hot source or group of copies is spread over all of them.

Defined cases: a document without words is packed with 0 words; a missing source is
a source of its own; repeated rows are of one cluster and never share a bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.tables import free_name
from cohortlens.llm.text import blocks, count_words, hash_texts, parts
from cohortlens.session import materialize

CAPACITY = 2048
SOURCE_LIMIT = 2
SHARD_ROWS = 8192


def best_fit(sizes: list[int], sources: list[object], clusters: list[object], capacity: int, source_limit: int) -> list[int]:
    """Bin of each item; items come in the order they are to be placed, none larger than ``capacity``."""
    once_more: dict[object, int] = {}
    repeated: dict[object, int] = {}
    for c in clusters:
        if c in once_more:
            repeated.setdefault(c, len(repeated))
        once_more[c] = 1
    source_bit: dict[object, int] = {}
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use = 0
    # a bin's bitmaps: level k of ``held`` has the sources it holds more than k times
    held: list[list[int]] = []
    marks: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s_bit = 1 << source_bit.setdefault(source, len(source_bit))
        # clusters that come once can't conflict and need no bit
        c_bit = 1 << repeated[cluster] if cluster in repeated else 0
        chosen = -1
        residual = size - 1
        while chosen < 0:
            later = in_use >> (residual + 1)
            if not later:
                break
            residual += 1 + (later & -later).bit_length() - 1
            for place, b in enumerate(by_residual[residual]):
                if not marks[b] & c_bit and not held[b][-1] & s_bit:
                    chosen = b
                    del by_residual[residual][place]
                    if not by_residual[residual]:
                        in_use &= ~(1 << residual)
                    break
        if chosen < 0:
            chosen, residual = len(marks), capacity
            marks.append(0)
            held.append([0] * source_limit)
        marks[chosen] |= c_bit
        for level in range(source_limit):
            if not held[chosen][level] & s_bit:
                held[chosen][level] |= s_bit
                break
        by_residual[residual - size].append(chosen)
        in_use |= 1 << (residual - size)
        out.append(chosen)
    return out


def measured(docs: DataFrame, text: str, keep_text: bool, names: tuple[str, str, str]) -> DataFrame:
    """Add word count, cluster (a hash of the words, case and spacing apart) and a row number, and store the rows."""
    size, cluster, number = names
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*fields, T.StructField(size, T.LongType()), T.StructField(cluster, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(text)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), pa.array(count_words(texts)), pa.array(hash_texts(texts, fold=True).view(np.int64))],
                names=[*(f.name for f in fields), size, cluster])

    return materialize(docs.mapInArrow(run, schema).withColumn(number, F.monotonically_increasing_id()), "sized")


def pack_rows(rows: DataFrame, *, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pack rows of ``number``, ``source``, ``cluster`` and ``size``.

    One row per piece: ``number``, ``bin_id``, ``piece`` (from 0), ``start`` (its first word) and ``n_words``.
    """
    shards = max(1, -(-rows.count() // shard_rows))
    schema = "number long, bin_id long, piece int, start long, n_words long"
    dealt = rows.select("number", "source", "cluster", "size", F.pmod(F.xxhash64("number"), F.lit(shards)).alias("shard"))

    def pack(group: pa.Table) -> pa.Table:
        number, size, cluster = (group.column(c).to_numpy() for c in ("number", "size", "cluster"))
        sources = group.column("source").to_pylist()
        shard = int(group.column("shard")[0].as_py())
        whole = np.where(size > 0, (size - 1) // capacity, 0)
        rest = size - whole * capacity
        order = np.lexsort((number, cluster, -rest))
        bins = best_fit(rest[order].tolist(), [sources[i] for i in order], cluster[order].tolist(), capacity, source_limit)
        opened = max(bins, default=-1) + 1
        # pieces that fill a bin
        row = np.repeat(np.arange(len(size)), whole)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
        out_row = np.concatenate([order, row])
        out_piece = np.concatenate([whole[order], piece])
        out_bin = np.concatenate([np.array(bins, np.int64), opened + np.arange(len(row))]) + (shard << 32)
        words = np.concatenate([rest[order], np.full(len(row), capacity)])
        return pa.table({"number": pa.array(number[out_row]), "bin_id": pa.array(out_bin), "piece": pa.array(out_piece.astype(np.int32)),
                         "start": pa.array(out_piece.astype(np.int64) * capacity), "n_words": pa.array(words.astype(np.int64))})

    return dealt.groupBy("shard").applyInArrow(pack, schema)


def plan_packing(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", source: str = "source", **limits) -> DataFrame:
    """One row per piece: ``bin_id``, id, ``piece``, ``start``, ``n_words``, ``source`` and ``cluster``; texts aren't moved."""
    slim = docs.select(F.col(id_column).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = measured(slim, "text", False, ("size", "cluster", "number"))
    plan = pack_rows(rows, **limits)
    return plan.join(rows.select("number", "id", "source", "cluster"), "number").select(
        "bin_id", F.col("id").alias(id_column), "piece", "start", "n_words", "source", "cluster")


def packed_pieces(docs: DataFrame, *, text: str = "text", source: str = "source", **limits) -> DataFrame:
    """The same with every column of ``docs``; the text is cut to the piece, spaces inside it kept."""
    names = tuple(free_name(docs, f"packing_{x}") for x in ("size", "cluster", "number"))
    rows = measured(docs, text, True, names)
    plan = pack_rows(rows.select(F.col(names[2]).alias("number"), F.col(source).alias("source"), F.col(names[1]).alias("cluster"),
                                 F.col(names[0]).alias("size")), **limits)
    extra = ("bin_id", "piece", "start", "n_words")
    clash = {c: free_name(docs, c) for c in extra}
    both = rows.join(plan.select(F.col("number").alias(names[2]), *(F.col(c).alias(clash[c]) for c in extra)), names[2])
    both = both.select(*(clash[c] for c in extra), *docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(text)
            start, n = batch.column(clash["start"]).to_numpy(), batch.column(clash["n_words"]).to_numpy()
            out: list[str | None] = [None] * batch.num_rows
            missing = texts.is_null().to_numpy(zero_copy_only=False)
            for b in blocks(texts):
                begins, ends, owner = b.words()
                first = np.searchsorted(owner, np.arange(b.n), "left")
                data = b.data.tobytes()
                for k in range(b.n):
                    row = b.first + k
                    if not missing[row]:
                        lo = first[k] + start[row]
                        out[row] = data[begins[lo] : ends[lo + n[row] - 1]].decode("utf-8") if n[row] else ""
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, texts.type) if name == text else batch.column(name) for name in batch.schema.names], names=batch.schema.names)

    return both.mapInArrow(cut, both.schema)
