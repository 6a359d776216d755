"""Near copies by the Jaccard similarity of word shingles: MinHash buckets, confirmed on the texts.

Texts of equal shingle sets are one node. A node's signature has the least of its
shingles' hashes under ``BANDS * ROWS`` functions; each band of ``ROWS`` of them is a
bucket. Two nodes of similarity s share one of the buckets with probability
1 - (1 - s^4)^20: 0.99997 at 0.8. Of a pair that shares a bucket, sketches are compared
(the last byte of each least hash): a pair at 0.8 has fewer than ``ALIKE`` equal ones in
less than one case in a million. Pairs that pass are confirmed by the exact similarity of
their sets.

Buckets are compared leader by leader, not as a square, and one band before the others: a
leader (the member that shares most buckets with others, the centre of a group of copies)
meets the members of its bucket that aren't in its component yet, and leaves it. A bucket
is done when all that is left in it hangs together. So a large group of copies hangs
together after the first band, its members meet one leader each, and later bands pass it over.

What is left then is mostly a little less than 0.8 alike, and in a large group nearly all of
it would meet each other in vain. Members left are dealt anew, by their rarest shingles: two
texts that share as many as 0.8 asks for must share one of them (``rare_buckets``). These
buckets go on with eight times as many leaders a round, until none is apart. No pair of a
bucket is left undecided unless its ends are in one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.components import connected_components
from cohortlens.llm.text import blocks, mix, pair_hash, parts
from cohortlens.session import materialize

BANDS, ROWS = 20, 4
#: least similarity, as a fraction that is compared in whole numbers
LEAST = (4, 5)
#: equal bytes of two sketches, at least
ALIKE = 44
#: bands compared together, one group after the other
STEPS = ((0,), tuple(range(1, BANDS)))
#: by how much the number of leaders of a bucket that isn't done grows
MORE = 8
#: bytes of texts whose shingles a worker holds at once
SMALL = 1 << 18
#: members that a leader's text is sent along with
ALONG = 1024

_rng = np.random.Generator(np.random.PCG64(20240301))
_FACTOR = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFT = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def shingles(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per block: its first row, the number of different shingles of each text, and their hashes, ascending in a text.

    A shingle is ``width`` words, or all words of a text that has fewer; case of A-Z and kind of space don't count.
    """
    for b in blocks(texts, SMALL):
        low = b.lowered()
        starts, stops, owner = low.words()
        h = low.hashes(starts, stops)
        n = np.bincount(owner, minlength=b.n)
        left = np.cumsum(n)[owner] - np.arange(len(h))  # words from here to the text's end
        out = h.copy()
        for k in range(1, width):
            at = np.flatnonzero(left > k)
            out[at] = pair_hash(out[at], h[at + k])
        whole = left >= np.minimum(n[owner], width)
        out, owner = out[whole], owner[whole]
        order = np.lexsort((out, owner))
        out, owner = out[order], owner[order]
        new = np.r_[True, (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])] if len(out) else np.zeros(0, bool)
        yield b.first, np.bincount(owner[new], minlength=b.n), out[new]


def signature_columns(texts: pa.Array, width: int) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """A hash of each text's shingle set, the set's size, its sketch, and its buckets (none for a text without words)."""
    sets, sizes, buckets = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros((len(texts), BANDS), np.int64)
    sketch = np.zeros((len(texts), BANDS * ROWS), np.uint8)
    for first, n, values in shingles(texts, width):
        some = np.flatnonzero(n)
        sizes[first : first + len(n)] = n
        if not len(some):
            continue
        begin = np.cumsum(n[some]) - n[some]
        sets[first + some] = mix(np.add.reduceat(mix(values ^ _SHIFT[0]), begin) + n[some].astype(np.uint64)).view(np.int64)
        for band in range(BANDS):
            key = np.full(len(some), band, np.uint64)
            for k in range(band * ROWS, band * ROWS + ROWS):
                least = np.minimum.reduceat(values * _FACTOR[k] + _SHIFT[k], begin)
                key = pair_hash(key, least)
                sketch[first + some, k] = (mix(least) & np.uint64(255)).astype(np.uint8)
            buckets[first + some, band] = key.view(np.int64)
    offsets = np.r_[0, np.cumsum(np.where(sizes > 0, BANDS, 0))].astype(np.int32)
    return (pa.array(sets), pa.array(sizes), pa.array([r.tobytes() for r in sketch], pa.binary()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(buckets[sizes > 0].ravel())))


def with_signature(
    docs: DataFrame, text: str, into: tuple[str, str, str, str], width: int, more: Mapping[str, Callable[[pa.Array], pa.Array]] | None = None,
) -> DataFrame:
    """Add the hash of the shingle set, its size, its sketch and its buckets, and ``more`` whole numbers of the texts in the same pass."""
    more = dict(more or {})
    names = [*docs.columns, *into, *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 256):
            texts = batch.column(text)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *signature_columns(texts, width), *(number(texts) for number in more.values())], names=names)

    kinds = (T.LongType(), T.LongType(), T.BinaryType(), T.ArrayType(T.LongType()), *(T.LongType() for _ in more))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip((*into, *more), kinds, strict=True))]))


def alike(met: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` of ``met`` whose sketches agree in ``ALIKE`` places or more, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("one", "other"))
            keep = pa.array((one == other).sum(axis=1) >= ALIKE)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    found = met.select("a", "b", "one", "other").mapInArrow(run, "a long, b long")
    # two leaders of a bucket meet each other from both sides
    return found.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.*")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs ``a`` (a leader), ``b`` whose texts' shingle sets are at least ``LEAST`` alike.

    Members' texts are sent to their leader's, at most about ``ALONG`` of them to one place, to which
    the leader's own text is sent once. A task holds the set of one leader while members pass by.
    """
    spots = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / ALONG).alias("spots"))
    spots = materialize(spots, "spots")
    lead = texts.join(spots, texts["row"] == spots["a"]).select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("spots") - 1)).alias("spot"), F.lit(None).cast("long").alias("b"), "text")
    # written, so that its size is known: few pairs are broadcast to the texts, which then stay where they are
    placed = materialize(pairs.join(spots, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("spots")).alias("spot")), "placed")
    follow = texts.join(placed, texts["row"] == placed["b"]).select("a", "spot", "b", "text")
    stream = lead.unionByName(follow).repartition("a", "spot").sortWithinPartitions("a", "spot", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = np.zeros(0, np.uint64)
        for batch in parts(batches, 256):
            ends, members, found = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for first, n, values in shingles(batch.column("text"), width):
                for i, own in enumerate(np.split(values, np.cumsum(n)[:-1]), first):
                    if members[i] is None:
                        leader = own
                        continue
                    common = len(np.intersect1d(leader, own, assume_unique=True))
                    if LEAST[1] * common >= LEAST[0] * (len(leader) + len(own) - common):
                        found.append((ends[i], members[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return stream.mapInArrow(run, "a long, b long")


def rare_buckets(members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``bucket``, ``row``, ``size``, ``shared``: the rarest shingles of each row of ``members`` (``bucket``, ``row``, ``size``).

    A partner in one of a row's buckets has its least size or more, and p/q of the row's own size. At similarity p/q
    both share p/(p+q) of the sum of their sizes, so the rarest shingle they share is among the first
    size - shared + 1 of either, in ascending order of the members that have it, ties by hash. Shingles that one
    member alone has take their places but are no buckets. ``shared`` counts the row's shingles from the bucket's on,
    the most it shares with a text of which this one is the rarest they share.
    """
    p, q = LEAST
    least = members.groupBy("bucket").agg(F.min("size").alias("least"))
    rows = members.join(least, "bucket").groupBy("row", "size").agg(F.min("least").alias("least"))
    # in whole numbers: shared >= ceil(p * (q * size + max(q * least, p * size)) / (q * (p + q)))
    shared = F.ceil(p * (q * F.col("size") + F.greatest(q * F.col("least"), p * F.col("size"))) / F.lit(q * (p + q)))
    rows = materialize(rows.select("row", "size", (F.col("size") - shared + 1).alias("places")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 256):
            own = batch.column("row").to_numpy()
            for first, n, values in shingles(batch.column("text"), width):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own[first : first + len(n)], n)), pa.array(values.view(np.int64))], names=["row", "bucket"])

    each = materialize(texts.join(rows, "row").select("row", "text").mapInArrow(run, "row long, bucket long"), "shingles")
    frequent = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # rows without any frequent shingle end here; the others' lonely ones come first
    mine = Window.partitionBy("row")
    place = F.row_number().over(mine.orderBy("n", "bucket")) + F.col("size") - F.count(F.lit(1)).over(mine)
    placed = each.join(frequent, "bucket").join(rows, "row").withColumn("place", place).where("place <= places")
    return placed.select("bucket", "row", "size", (F.col("size") - F.col("place") + 1).alias("shared"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``row``, ``root`` after joining the components that ``links`` tie together."""
    ends = links.join(roots.select(F.col("row").alias("a"), F.col("root").alias("x")), "a").join(
        roots.select(F.col("row").alias("b"), F.col("root").alias("y")), "b").where("x <> y").select("x", "y").distinct()
    new = materialize(connected_components(ends, "x", "y"), "merged").select(F.col("node").alias("root"), F.col("root").alias("into"))
    return materialize(roots.join(new, "root", "left").select("row", F.coalesce("into", "root").alias("root")), "roots")


def _apart(members: DataFrame) -> DataFrame:
    """The ``members`` (``bucket``, ``root``, ``size``, ``shared``) of buckets that don't hang together yet, but for those
    that share too little with a text of the bucket's least size, and of p/q of their own size, to be p/q alike."""
    p, q = LEAST
    some = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("size").alias("least")).where("low < high")
    hope = q * (p + q) * F.col("shared") >= p * (q * F.col("size") + F.greatest(q * F.col("least"), p * F.col("size")))
    return members.join(some.select("bucket", "least"), "bucket").where(hope).drop("least")


def copy_components(nodes: DataFrame, texts: DataFrame, width: int, links: DataFrame | None = None) -> DataFrame:
    """``node``, ``root`` of all nodes that share a bucket or have a link; ``nodes`` has ``row``, ``size``, ``sketch``, ``buckets``,
    ``texts`` row and text. The stored ``links`` ``a``, ``b`` are known to be copies: their ends needn't meet again.
    """
    members = nodes.select("row", "size", F.posexplode("buckets").alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(members.join(shared, "bucket"), "buckets")
    weight = members.groupBy("row").agg(F.sum("n").alias("weight"))
    known = materialize(nodes.select("row", "sketch").join(weight, "row"), "known")
    roots = known.select("row", F.col("row").alias("root"))
    if links is not None and not links.isEmpty():
        ends = links.select(F.explode(F.array("a", "b")).alias("row"))
        roots = _merged(known.select("row").union(ends).distinct().withColumn("root", F.col("row")), links)
    for bands in STEPS:
        open_, leaders = members.where(F.col("band").isin(*bands)).select("bucket", "row", "size", F.col("size").alias("shared")), 1
        while True:
            now = materialize(_apart(open_.join(roots, "row")).join(known, "row"), "members")
            if now.isEmpty():
                break
            place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("weight").desc(), "row"))
            first = materialize(now.withColumn("place", place).where(F.col("place") <= leaders).drop("place"), "leaders")
            lead = first.select("bucket", F.col("row").alias("a"), F.col("root").alias("a_root"), F.col("size").alias("a_size"),
                                F.col("shared").alias("a_shared"), F.col("sketch").alias("one"))
            follow = now.select("bucket", F.col("row").alias("b"), F.col("root").alias("b_root"), F.col("size").alias("b_size"),
                                F.col("shared").alias("b_shared"), F.col("sketch").alias("other"))
            # sets that share no more can't be that alike, nor can sets of sizes further apart
            able = (F.col("a_root") != F.col("b_root")) & (
                sum(LEAST) * F.least("a_shared", "b_shared") >= LEAST[0] * (F.col("a_size") + F.col("b_size")))
            pairs = materialize(alike(lead.join(follow, "bucket").where(able)), "pairs")
            if not pairs.isEmpty():
                roots = _merged(roots, materialize(confirmed(pairs, texts, width), "copies"))
            open_ = now.select("bucket", "row", "size", "shared").join(first.select("bucket", "row"), ["bucket", "row"], "left_anti")
            if leaders == 1:
                left = materialize(_apart(open_.join(roots, "row")), "left")
                if left.isEmpty():
                    break
                open_ = materialize(rare_buckets(left, texts, width), "rare")
            leaders *= MORE
    return roots.withColumnRenamed("row", "node")
