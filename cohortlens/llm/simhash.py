"""SimHash near-duplicates: bit-sliced comparison inside blocks that share enough bits.

A fingerprint sums, bit by bit, the XXH64 hashes of a text's word shingles. Two
fingerprints within two bits of each other agree on two of four 16-bit quarters,
and of the other 32 bits on one of three parts. Those 43 bits with the choice made
are a key: fingerprints are dealt by all 18 keys and compared within a key only.
A key leaves 21 bits open, so it can't hold more than 2^21 different fingerprints.

Comparison is bit-sliced. Plane ``p`` holds bit ``p`` of 64 fingerprints a word.
XOR of a plane with itself moved by ``lag`` lanes gives that bit's difference for
all pairs at that lag at once; carry-save counters add the planes up, and words
whose pairs have all passed the radius are left out of the remaining planes.

Defined cases: a missing text is an empty one; texts without words have fingerprint
zero and are linked like others; a missing ``doc_id`` never names a component, which
is null only if all ids in it are missing; repeated rows stay, each with its result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.components import connected_components
from cohortlens.llm.nearcopies import confirmed, copy_components, with_signature
from cohortlens.llm.tables import batches_of, free_name, row_bits, rows_of_bits
from cohortlens.llm.text import parts
from cohortlens.session import kept, materialize, temporary_tables

RADIUS = 2
SEED = 42
#: bit ranges (low, width) of the quarters, and of the three parts of the 32 bits two quarters leave
QUARTERS = tuple((16 * i, 16) for i in range(4))


def _masks() -> list[int]:
    out = []
    for kept in combinations(range(4), 2):
        fixed = sum(0xFFFF << QUARTERS[q][0] for q in kept)
        rest = [QUARTERS[q][0] + i for q in range(4) if q not in kept for i in range(16)]
        for part in (rest[:11], rest[11:22], rest[22:]):
            out.append(fixed | sum(1 << i for i in part))
    return out


MASKS = _masks()


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of the text's word shingles, repeats included; of all its words if they are fewer."""
    words = text.lower().split()  # on bytes: A-Z and ASCII spaces only
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    view = memoryview(line)
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    return [digest(view[s:e], SEED) for s, e in zip(starts, ends[width - 1 :], strict=True)]


def fingerprint_batch(texts: list[str | None], width: int) -> np.ndarray:
    """Fingerprints as signed 64-bit numbers."""
    out = np.zeros(len(texts), np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []

    def flush() -> None:
        if not owners:
            return
        h = np.array(hashes, np.uint64)
        first = np.cumsum([0, *(n for _, n in owners)])[:-1]
        total = np.zeros((len(owners), 64), np.int64)
        # bit sums of runs of hashes, so that no text, however long, makes a large table of bits
        for lo in range(0, len(h), 1 << 16):
            part = h[lo : lo + (1 << 16)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = np.searchsorted(first, np.arange(lo, lo + len(part)), "right") - 1
            cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            total[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
        sizes = np.array([n for _, n in owners])
        out[[i for i, _ in owners]] = ((2 * total > sizes[:, None]) * powers).sum(1, dtype=np.uint64)
        hashes.clear()
        owners.clear()

    for i, text in enumerate(texts):
        own = shingle_hashes((text or "").encode("utf-8", "surrogatepass"), width)
        if own:
            hashes.extend(own)
            owners.append((i, len(own)))
        if len(hashes) > 1 << 16:
            flush()
    flush()
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, text: str, into: str, width: int, keep_text: bool = False) -> DataFrame:
    """Add the fingerprint as a long; the text column goes unless it is to be kept."""
    fields = [f for f in docs.schema.fields if keep_text or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            prints = np.zeros(batch.num_rows, np.int64)
            for lo in range(0, batch.num_rows, 256):
                prints[lo : lo + 256] = fingerprint_batch(batch.column(text).slice(lo, 256).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(prints)],
                                             names=[*(f.name for f in fields), into])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(into, T.LongType())]))


def _planes(prints: np.ndarray) -> np.ndarray:
    """64 rows of words: bit i of row p is bit p of fingerprint i."""
    words = -(-len(prints) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def close_pairs(key: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of equal keys whose fingerprints differ in at most ``radius`` (0 to 2) bits.

    ``key`` is sorted. Lags run up to the size of the largest group.
    """
    n = len(key)
    nothing = np.zeros(0, np.int64)
    if n < 2:
        return nothing, nothing
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[begins, n])
    left = np.repeat(sizes, sizes) - (np.arange(n) - np.repeat(begins, sizes)) - 1  # partners after each position
    width = int(sizes.max()) - 1
    planes = np.pad(_planes(prints), ((0, 0), (0, -(-width // 64) + 1)))
    words = -(-n // 64)
    firsts, seconds = [], []
    for lag in range(1, width + 1):
        paired = np.zeros(words * 64, bool)
        paired[:n] = left >= lag
        lanes = np.packbits(paired, bitorder="little").view(np.uint64)
        active = np.flatnonzero(lanes)
        over = ~lanes[active]
        ones, twos = np.zeros_like(over), np.zeros_like(over)
        whole, rest = divmod(lag, 64)
        for p in range(64):
            row = planes[p]
            moved = row[active + whole]
            if rest:
                moved = (moved >> np.uint64(rest)) | (row[active + whole + 1] << np.uint64(64 - rest))
            differ = row[active] ^ moved
            carry = ones & differ
            ones ^= differ
            over |= carry & twos
            twos ^= carry
            over |= (ones & twos) if radius == 2 else twos if radius == 1 else ones | twos
            if p % 8 == 7:
                alive = over != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not alive.all():
                    active, over, ones, twos = active[alive], over[alive], ones[alive], twos[alive]
                    if not len(active):
                        break
        if len(active):
            hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, bit = np.nonzero(hit)
            i = active[word] * 64 + bit
            firsts.append(i)
            seconds.append(i + lag)
    if not firsts:
        return nothing, nothing
    return np.concatenate(firsts), np.concatenate(seconds)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest position that each position reaches through the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _keys(prints: Column) -> Column:
    """All 18 keys of a fingerprint: the number of the choice and the bits it keeps."""
    signed = [m - (1 << 64) if m >> 63 else m for m in MASKS]
    return F.array(*(F.struct(F.lit(i).cast("byte").alias("choice"), prints.bitwiseAND(F.lit(m)).alias("bits"))
                     for i, m in enumerate(signed)))


def fingerprint_links(prints: DataFrame, column: str) -> DataFrame:
    """Links ``a``, ``b`` between different fingerprints at most ``RADIUS`` bits apart.

    ``prints`` has each fingerprint once. Within a run of keys the found pairs are
    given as a forest: every pair's ends are tied, by as many links as there are members.
    """
    dealt = prints.select(F.col(column).alias("print"), F.explode(_keys(F.col(column))).alias("key")).select(
        "key.choice", "key.bits", "print")
    dealt = dealt.repartition("choice", "bits").sortWithinPartitions("choice", "bits")

    def compare(bits: np.ndarray, choice: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        change = np.r_[True, (bits[1:] != bits[:-1]) | (choice[1:] != choice[:-1])]
        key = np.cumsum(change)
        # keys with one member have no pair
        size = np.bincount(key)[key]
        key, own = key[size > 1], own[size > 1]
        i, j = close_pairs(key, own.view(np.uint64))
        root = _forest(i, j, len(own)) if len(i) else np.arange(len(own))
        tied = np.flatnonzero(root != np.arange(len(own)))
        return pa.RecordBatch.from_arrays([pa.array(own[root[tied]]), pa.array(own[tied])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("bits", "choice", "print")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            bits, choice, _ = held
            # the last key may go on in the next batch
            last = int(np.flatnonzero(np.r_[True, (bits[1:] != bits[:-1]) | (choice[1:] != choice[:-1])])[-1])
            if last >= 1 << 16:
                yield compare(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None:
            yield compare(*held)

    return dealt.mapInArrow(run, "a long, b long")


def fingerprint_components(rows: DataFrame, column: str) -> DataFrame:
    """``column``, ``root``: each different fingerprint of ``rows`` and the name of its component."""
    prints = materialize(rows.select(column).distinct(), "fingerprints")
    linked = connected_components(fingerprint_links(prints, column)).withColumnRenamed("node", column)
    return prints.join(linked, column, "left").select(column, F.coalesce("root", column).alias("root"))


def near_duplicates(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", width: int = 3) -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id of all rows it is linked to."""
    rows = materialize(with_fingerprint(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")),
                                        "text", "print", width), "simhash")
    roots = materialize(fingerprint_components(rows, "print"), "simhash-roots")
    least = rows.groupBy("print").agg(F.min("id").alias("id")).join(roots, "print").groupBy("root").agg(
        F.min("id").alias("component_id"))
    named = roots.join(least, "root").select("print", "component_id")
    return rows.join(named, "print").select(
        F.col("id").alias(id_column), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def close_nodes(nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Links ``a``, ``b`` from the first row of each component of fingerprints to its others whose shingle sets are 0.8 alike.

    ``nodes`` has ``row`` and ``print``, ``texts`` row and text. Equal counts of repeated shingles make texts of
    different sets close, so links are confirmed on the texts.
    """
    linked = materialize(fingerprint_components(nodes, "print"), "print-roots")
    first = nodes.groupBy("print").agg(F.min("row").alias("row")).join(linked, "print").groupBy("root").agg(F.min("row").alias("a"))
    named = materialize(linked.join(first, "root").select("print", "a"), "named")
    pairs = materialize(nodes.join(named, "print").where(F.col("row") != F.col("a")).select("a", F.col("row").alias("b")), "close")
    return materialize(confirmed(pairs, texts, width), "close-copies")


def keep_one(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", width: int = 5) -> DataFrame:
    """One row of each component of texts whose shingle sets are 0.8 alike: that of the smallest id (missing ids last),
    the first stored one among repeats. Texts without words are copies of each other.

    Fingerprints at most ``RADIUS`` bits apart are found first, as in :func:`near_duplicates`; texts at 0.8 differ in
    nine bits or so, and are found by MinHash buckets among what isn't linked by then."""
    name, size, sketch, buckets, number, prints = (
        free_name(docs, f"copies_{c}") for c in ("set", "size", "sketch", "buckets", "row", "print"))
    with batches_of(docs.sparkSession, 512):
        signed = with_signature(docs, text, (name, size, sketch, buckets), width,
                                {prints: lambda texts: pa.array(fingerprint_batch(texts.to_pylist(), width))})
        marked = materialize(signed.withColumn(number, F.monotonically_increasing_id()), "marked")
    rows = marked.select(F.col(name).alias("set"), F.col(size).alias("size"), F.col(sketch).alias("sketch"), F.col(buckets).alias("buckets"),
                         F.col(number).alias("row"), F.col(id_column).alias("id"), F.col(prints).alias("print"))
    texts = marked.select(F.col(number).alias("row"), F.col(text).alias("text"))
    with temporary_tables(docs.sparkSession), batches_of(docs.sparkSession, 512):
        # texts of one set have the same size, sketch and buckets; their fingerprints differ if shingles repeat
        nodes = materialize(rows.groupBy("set").agg(
            F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best"),
            F.min(F.struct("row", "size", "sketch", "buckets", "print")).alias("node")).select("best", "node.*"), "copies-nodes")
        links = close_nodes(nodes.where("size > 0").select("row", "print"), texts, width)
        roots = copy_components(nodes, texts, width, links)
        chosen = materialize(nodes.select("best", "row").join(roots.withColumnRenamed("node", "row"), "row", "left").groupBy(
            F.coalesce("root", "row")).agg(F.min("best").alias("best")).select(F.col("best.row").alias(number)), "chosen")
        bits = kept(row_bits(chosen, number), "chosen-bits")
    return rows_of_bits(marked, number, bits).select(*docs.columns)
