"""Approximate nearest neighbours by inner product: NN-descent graph, greedy graph search.

Index. Equal vectors are one node. Nodes start with the nearest of random groups
and of random-hyperplane cells (large cells are cut at random, so no group is
larger than ``group``). A round of NN-descent then joins neighbours of neighbours:
every node sends itself to the nodes on its list; a node that got several compares
them with each other, and pairs better than the worst on either's list are sent
back and merged. Only pairs with a member that is new on its list are compared.
Rounds end when fewer than one list place in 200 changes.

To be sent to, a node may be on very many lists. A partition sends at most
``received`` members to one node, the nearest; so does the node after all have
come. This bounds the work of a hub and is part of the approximation.

Search. A query starts with its own node's list. A step expands the best nodes of
its pool that were not expanded yet: their lists are joined, the new candidates
are scored where their vectors are, and those better than the pool's worst are
merged. Steps end when no pool has anything left to expand. Pools are scored once
more with the original vectors in double precision, and nodes become rows again.

Vectors travel as 8-bit codes with a scale; all scores returned are exact.

Defined cases: vectors that are missing, zero, or hold missing or non-finite
components take no part, nor do rows without id, nor vectors whose length is not
the most frequent one (of equally frequent ones, the longest); of rows with one id
the smallest vector counts; with 20 or fewer candidates, all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import materialize

GRAPH = "id long, code binary, nbrs array<long>, sims array<float>, fresh array<boolean>"


def clean_vectors(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``id``, ``vec`` of the rows that take part, each id once."""
    v = F.transform(vector, lambda x: x.cast("double"))
    good = rows.select(F.col(id_column).cast("long").alias("id"), v.alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull()).where(_sound("vec"))
    sizes = good.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    width = sizes[0]["size"] if sizes else 0
    return good.where(F.size("vec") == width).groupBy("id").agg(F.min("vec").alias("vec"))


def _sound(vec: str) -> Column:
    return F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)


def encode(vectors: np.ndarray) -> list[bytes]:
    """A float32 scale and 8-bit components."""
    scale = np.maximum(np.abs(vectors).max(1), 1e-300) / 127
    small = np.rint(vectors / scale[:, None]).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale.astype(np.float32), small, strict=True)]


def decode(codes: pa.Array) -> np.ndarray:
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    if len(codes) == 0:
        return np.zeros((0, 0), np.float32)
    _, offsets, data = codes.buffers()
    ends = np.frombuffer(offsets, np.int32)[codes.offset : codes.offset + len(codes) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(len(codes), -1)
    scale = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    return np.ascontiguousarray(raw[:, 4:]).view(np.int8).astype(np.float32) * scale


def _runs(batches: Iterator[pa.RecordBatch], key: str, least: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups of ``key`` from batches in its order."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        k = batch.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left"))
        if rows >= least and (cut or k[0] != held[0].column(key)[0].as_py()):
            t = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            if cut == 0:
                all_k = t.column(key).to_numpy()
                whole = int(np.searchsorted(all_k, k[-1], "left"))
                yield t.slice(0, whole)
                held = [*t.slice(whole).to_batches(), batch]
            else:
                yield t
                held = [batch.slice(cut)]
            rows = sum(b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _best_of_each(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest different ``other`` of each ``owner``."""
    if not len(owner):
        return np.zeros(0, np.int64)
    o = np.lexsort((-sim, other, owner))
    first = np.r_[True, (owner[o][1:] != owner[o][:-1]) | (other[o][1:] != other[o][:-1])]
    o = o[first]
    o = o[np.lexsort((other[o], -sim[o], owner[o]))]
    rank = np.arange(len(o)) - np.searchsorted(owner[o], owner[o], "left")
    return o[rank < k]


def _pairs_batch(owner: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(owner), pa.array(other), pa.array(sim.astype(np.float32))], names=["id", "other", "sim"])


def _first_pairs(nodes: DataFrame, cells: int, k: int, group: int, seed: int) -> DataFrame:
    """Near pairs inside random groups and cells of random hyperplanes."""
    n = nodes.count()
    bits = max(0, math.ceil(math.log2(max(n, 1) / (group / 2))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            x = decode(batch.column("code"))
            if not len(x):
                continue
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(cells, x.shape[1], bits)).astype(np.float32)
            for c in range(cells):
                cell = ((x @ planes[c] > 0) @ (1 << np.arange(bits, dtype=np.int64))) if c and bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("code"), pa.array(np.full(len(x), c, np.int32)), pa.array(cell)],
                                                 names=["id", "code", "draw", "cell"])

    dealt = nodes.mapInArrow(place, "id long, code binary, draw int, cell long")
    # a cell with more than a group's nodes is cut at random
    sizes = dealt.groupBy("draw", "cell").count()
    parts = F.ceil(F.col("count") / group).cast("long")
    cut = materialize(sizes.select("draw", "cell", parts.alias("parts")), "cells")
    grouped = dealt.join(cut, ["draw", "cell"]).select(
        "id", "code", F.xxhash64("draw", "cell", F.pmod(F.xxhash64("id", "draw"), F.col("parts"))).alias("key"))
    grouped = grouped.repartition("key").sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "key"):
            key, ids, x = t.column("key").to_numpy(), t.column("id").to_numpy(), decode(t.column("code"))
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            found = []
            for a, b in zip(begins, np.r_[begins[1:], len(key)], strict=True):
                if b - a < 2:
                    continue
                s = x[a:b] @ x[a:b].T
                np.fill_diagonal(s, -np.inf)
                m = min(k, b - a - 1)
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                found.append((np.repeat(ids[a:b], m), ids[a:b][top].ravel(), np.take_along_axis(s, top, 1).ravel()))
            if found:
                yield _pairs_batch(*(np.concatenate(f) for f in zip(*found, strict=True)))

    return grouped.mapInArrow(compare, "id long, other long, sim float")


def _merge(graph: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Lists with the pairs merged in; ``fresh`` marks what was not on the list before."""
    gathered = pairs.groupBy("id").agg(F.collect_list("other").alias("others"), F.collect_list("sim").alias("others_sim"))
    both = graph.join(gathered, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.arange(batch.num_rows)
            flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
            size = lambda c: batch.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            old, more = size("nbrs"), size("others")
            owner = np.concatenate([np.repeat(rows, old), np.repeat(rows, more)])
            other = np.concatenate([flat("nbrs"), flat("others")]).astype(np.int64)
            sim = np.concatenate([flat("sims"), flat("others_sim")]).astype(np.float32)
            was = np.arange(len(owner)) < old.sum()
            # what is on the list comes first among equals, so that it isn't taken for fresh
            o = np.lexsort((~was, other, owner))
            if len(o):
                o = o[np.r_[True, (owner[o][1:] != owner[o][:-1]) | (other[o][1:] != other[o][:-1])]]
            own_id = batch.column("id").to_numpy()[owner[o]]
            o = o[other[o] != own_id]
            o = o[np.lexsort((other[o], -sim[o], owner[o]))]
            rank = np.arange(len(o)) - np.searchsorted(owner[o], owner[o], "left")
            o = o[rank < k]
            ends = np.r_[0, np.cumsum(np.bincount(owner[o], minlength=batch.num_rows))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), v) for v in (pa.array(other[o]), pa.array(sim[o]), pa.array(~was[o]))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("code"), *lists], names=["id", "code", "nbrs", "sims", "fresh"])

    return both.mapInArrow(run, GRAPH)


def _join_round(graph: DataFrame, k: int, received: int) -> DataFrame:
    """Better pairs found by comparing the nodes that have a node on their lists."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("nbrs").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            member = np.repeat(np.arange(batch.num_rows), n)
            target = batch.column("nbrs").flatten().to_numpy()
            sim = batch.column("sims").flatten().to_numpy()
            fresh = batch.column("fresh").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            # a list that isn't full takes anything
            worst = np.where(n >= k, sim[np.maximum(ends - 1, 0)] if len(sim) else 0, -np.inf).astype(np.float32)
            kept = np.sort(_best_of_each(target, member, sim, received))
            m = member[kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(target[kept]), batch.column("id").take(pa.array(m)), batch.column("code").take(pa.array(m)), pa.array(sim[kept]),
                 pa.array(worst[m]), pa.array(fresh[kept])], names=["target", "id", "code", "sim", "worst", "fresh"])

    sent = graph.mapInArrow(send, "target long, id long, code binary, sim float, worst float, fresh boolean")
    sent = sent.repartition("target").sortWithinPartitions("target")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "target", 16_384):
            key, ids, sim, worst = (t.column(c).to_numpy() for c in ("target", "id", "sim", "worst"))
            fresh = t.column("fresh").to_numpy(zero_copy_only=False)
            x = decode(t.column("code"))
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            found = []
            for a, b in zip(begins, np.r_[begins[1:], len(key)], strict=True):
                own = np.arange(a, b)
                if len(own) > received:
                    own = own[np.argpartition(-sim[own], received - 1)[:received]]
                new = own[fresh[own]]
                if len(own) < 2 or not len(new):
                    continue
                s = x[new] @ x[own].T
                i, j = np.nonzero((s > worst[new][:, None]) & (new[:, None] != own[None, :]))
                found.append((ids[new[i]], ids[own[j]], s[i, j]))
                i, j = np.nonzero((s > worst[own][None, :]) & (new[:, None] != own[None, :]))
                found.append((ids[own[j]], ids[new[i]], s[i, j]))
            if found:
                owner, other, score = (np.concatenate(f) for f in zip(*found, strict=True))
                o = _best_of_each(owner, other, score, k)
                yield _pairs_batch(owner[o], other[o], score[o])

    return sent.mapInArrow(compare, "id long, other long, sim float")


def build_graph(nodes: DataFrame, *, k: int = 48, cells: int = 9, group: int = 384, received: int = 96, rounds: int = 8, seed: int = 11) -> DataFrame:
    """Neighbour lists of ``nodes`` (``id``, ``code``), nearest first."""
    empty = nodes.select("id", "code", F.array().cast("array<long>").alias("nbrs"), F.array().cast("array<float>").alias("sims"),
                         F.array().cast("array<boolean>").alias("fresh"))
    graph = materialize(_merge(empty, _first_pairs(nodes, cells, 16, group, seed), k), "graph")
    for _ in range(rounds):
        graph = materialize(_merge(graph, _join_round(graph, k, received), k), "graph")
        changed, places = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f))), F.sum(F.size("nbrs"))).first()
        if not places or changed < places / 200:
            break
    return graph


POOL = "id long, code binary, pool array<long>, sims array<float>, done array<boolean>"


def search_graph(graph: DataFrame, queries: DataFrame, *, pool: int = 192, width: int = 32, steps: int = 8) -> DataFrame:
    """``id``, ``pool``: for each node of ``queries`` (``id``), the nodes that a greedy search finds, nearest first."""
    state = materialize(graph.join(queries, "id", "left_semi").select(
        "id", "code", F.col("nbrs").alias("pool"), "sims", F.transform("nbrs", lambda x: F.lit(False)).alias("done")), "pools")
    lists = graph.select(F.col("id").alias("node"), "nbrs")
    codes = graph.select(F.col("id").alias("other"), F.col("code").alias("other_code"))
    for _ in range(steps):
        waiting = F.slice(F.filter(F.arrays_zip("pool", "done"), lambda e: ~e["done"]), 1, width)
        # a pool that isn't full takes anything
        worst = F.when(F.size("pool") >= pool, F.element_at("sims", -1)).otherwise(F.lit(float("-inf")).cast("float"))
        front = state.select("id", "code", worst.alias("worst"), F.explode(waiting).alias("e")).select("id", "code", "worst", F.col("e.pool").alias("node"))
        reached = front.join(lists, "node").select("id", "code", "worst", F.explode("nbrs").alias("other")).where("other <> id")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = (decode(batch.column("code")) * decode(batch.column("other_code"))).sum(1) if batch.num_rows else np.zeros(0, np.float32)
                at = np.flatnonzero(s > batch.column("worst").to_numpy())
                yield _pairs_batch(batch.column("id").to_numpy()[at], batch.column("other").to_numpy()[at], s[at])

        better = reached.join(codes, "other").mapInArrow(score, "id long, other long, sim float").distinct()
        gathered = better.groupBy("id").agg(F.collect_list("other").alias("others"), F.collect_list("sim").alias("others_sim"))
        both = state.join(gathered, "id", "left")

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = np.arange(batch.num_rows)
                flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
                size = lambda c: batch.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                old, more = size("pool"), size("others")
                done = flat("done").astype(bool)
                # the first ``width`` open ones were expanded in this step
                owner_old = np.repeat(rows, old)
                opened = np.cumsum(~done)
                before = np.r_[0, opened][np.searchsorted(owner_old, owner_old, "left")] if len(done) else opened
                done = done | (opened - before <= width)
                owner = np.concatenate([owner_old, np.repeat(rows, more)])
                other = np.concatenate([flat("pool"), flat("others")]).astype(np.int64)
                sim = np.concatenate([flat("sims"), flat("others_sim")]).astype(np.float32)
                done = np.concatenate([done, np.zeros(int(more.sum()), bool)])
                o = np.lexsort((~done, other, owner))
                if len(o):
                    o = o[np.r_[True, (owner[o][1:] != owner[o][:-1]) | (other[o][1:] != other[o][:-1])]]
                o = o[np.lexsort((other[o], -sim[o], owner[o]))]
                rank = np.arange(len(o)) - np.searchsorted(owner[o], owner[o], "left")
                o = o[rank < pool]
                ends = np.r_[0, np.cumsum(np.bincount(owner[o], minlength=batch.num_rows))].astype(np.int32)
                lists_ = [pa.ListArray.from_arrays(pa.array(ends), v) for v in (pa.array(other[o]), pa.array(sim[o]), pa.array(done[o]))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("code"), *lists_], names=["id", "code", "pool", "sims", "done"])

        state = materialize(both.mapInArrow(merge, POOL), "pools")
        if state.where(F.exists("done", lambda d: ~d)).isEmpty():
            break
    return state.select("id", "pool")


def nearest_neighbours(rows: DataFrame, is_query: Column, *, id_column: str = "vec_id", vector: str = "embedding", top: int = 20,
                       graph_settings: dict | None = None, search_settings: dict | None = None) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``top`` largest inner products found for each query row."""
    vectors = materialize(clean_vectors(rows, id_column, vector), "vectors")
    nodes = materialize(vectors.groupBy("vec").agg(F.min("id").alias("node")), "nodes")
    where = materialize(vectors.join(nodes, "vec").select("id", "node"), "places")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(encode(x), pa.binary())], names=["id", "code"])

    coded = materialize(nodes.select("node", "vec").mapInArrow(code, "id long, code binary"), "codes")
    graph = build_graph(coded, **(graph_settings or {}))
    queries = where.withColumnRenamed("id", id_column).where(is_query).select(F.col(id_column).alias("query"), "node")
    found = search_graph(graph, queries.select(F.col("node").alias("id")).distinct(), **(search_settings or {}))
    # a node's own copies are candidates too
    pairs = found.select(F.col("id").alias("node"), F.explode(F.concat("pool", F.array("id"))).alias("other")).distinct()
    a = nodes.select("node", F.col("vec").alias("a"))
    b = nodes.select(F.col("node").alias("other"), F.col("vec").alias("b"))
    product = F.reduce(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(a, "node").join(b, "other").select("node", "other", product.alias("score"))
    # of equal vectors no more than the first ``top`` and the query itself can be among the results
    copies = where.withColumn("turn", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("turn") <= top + 1)
    best_nodes = scored.withColumn("turn", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "other"))).where(
        F.col("turn") <= top + 1).drop("turn")
    candidates = best_nodes.join(copies.select(F.col("node").alias("other"), F.col("id").alias("vec_id")), "other")
    order = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    ranked = candidates.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= top + 1)
    lists = ranked.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("turn", "vec_id", "score"))).alias("all"))
    mine = queries.join(lists, "node").select("query", F.slice(F.filter("all", lambda e: e["vec_id"] != F.col("query")), 1, top).alias("best"))
    return mine.select(F.col("query").alias("query_id"), F.posexplode("best").alias("place", "e")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")
