"""Language-model scoring with a log-frequency Bloom filter of bigram counts.

Counting: every partition tallies its words and word pairs by 64-bit hash and the
tallies are added by hash. N, V and the words' counts are exact.

Filter: a pair's count is quantised to a level ``q`` on a logarithmic scale,
rounded down, and the pair is entered once for each level 1..q. A query probes
level 1, 2, ... until the first miss; the last hit is the count's level. For each
history the filter also holds, in the same way but rounded up, the counts that its
pairs keep after discounting.

A pair's key has 36 bits of its history's hash and 28 of its own: within a history
of a million different followers, one pair in 250 shares a count with another.

Model: interpolated absolute discounting,

    p(w | h) = (max(c(h,w) - D, 0) + (c(h) - kept(h)) p(w)) / c(h)

with p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), the base measure. All that discounting,
rounding and pairs below ``least_count`` leave over goes to p(w), so the
probabilities of a history add up to one but for false positives of the filter.

Size: words and filter are cut by hash into segments that hold at most
``segment_words`` words and ``segment_pairs`` pairs, each its own broadcast of a
size bounded by these parameters. A task looks up a large batch of text in one
segment after the other and drops each before it takes the next, so memory doesn't
grow with the corpus; the number of segments does.

Defined cases: a missing text is an empty one and has one token, its end; a
missing ``doc_id`` is not held out; with nothing to learn from, N and V are 0, and
every token has probability one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.tables import id_share
from cohortlens.llm.text import blocks, mix, pair_hash
from cohortlens.session import materialize

#: stand for the end and the beginning of a text; words are never hashed to these by design, only by chance 2^-64
END, BEGIN = np.uint64(0x6C62272E07BB0142), np.uint64(0x62B821756295C58D)
_ANY = np.uint64(0x27D4EB2F165667C5)
#: a pair's key keeps so many bits of its history's hash, and as many of the pair's as are left
_HISTORY_BITS = 36
_HISTORY_MASK = np.uint64(((1 << _HISTORY_BITS) - 1) << (64 - _HISTORY_BITS))


def pair_key(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits from which the history's part can be read, so that counting moves one number a pair."""
    return (history & _HISTORY_MASK) | (pair_hash(history, word) >> np.uint64(_HISTORY_BITS))


def history_key(key: np.ndarray) -> np.ndarray:
    """Under which the filter holds what a history's pairs keep; from the history's hash or a pair's key."""
    return mix((key & _HISTORY_MASK) ^ _ANY)


@dataclass(frozen=True)
class Tokens:
    """Tokens of a block: their hashes, the histories before them, and whose they are."""

    word: np.ndarray
    history: np.ndarray
    owner: np.ndarray


def block_tokens(block) -> Tokens:
    low = block.lowered()
    starts, stops, owner = low.words()
    n = np.bincount(owner, minlength=block.n) + 1
    last = np.cumsum(n) - 1
    is_end = np.zeros(len(owner) + block.n, bool)
    is_end[last] = True
    word = np.full(len(is_end), END)
    word[~is_end] = low.hashes(starts, stops)
    history = np.empty_like(word)
    history[1:] = word[:-1]
    history[np.r_[0, last[:-1] + 1]] = BEGIN
    return Tokens(word, history, np.repeat(np.arange(block.n), n))


def count_grams(docs: DataFrame, text: str, flush: int = 1_000_000) -> DataFrame:
    """``kind`` (1 word, 2 pair), ``key`` and ``n``, summed over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Tokens] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            words = np.concatenate([t.word for t in held])
            pairs = pair_key(np.concatenate([t.history for t in held]), words)
            held.clear()
            for kind, keys in ((1, words), (2, pairs)):
                key, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(n)],
                                                 names=["kind", "key", "n"])

        for batch in batches:
            for b in blocks(batch.column(text)):
                held.append(block_tokens(b))
                size += len(held[-1].word)
                if size >= flush:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    grams = docs.select(text).mapInArrow(run, "kind byte, key long, n long")
    return grams.groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Settings:
    discount: float = 0.75
    #: smallest count that a pair needs to be known; 1 keeps all
    least_count: int = 1
    #: ratio of neighbouring levels of the count scale
    log_base: float = 1.3
    #: probes of a Bloom query, and bits for an entry; a miss is taken for a hit in about 1 of 100 cases
    probes: int = 4
    bits: int = 10
    segment_words: int = 2_000_000
    segment_pairs: int = 8_000_000
    #: pairs of one block of the filter; a block is built by one task
    block_pairs: int = 32_768
    #: tokens that are looked up together
    group_tokens: int = 400_000


def _level_down(n: np.ndarray, s: Settings) -> np.ndarray:
    return 1 + np.floor(np.log(n / s.least_count) / math.log(s.log_base) + 1e-9).astype(np.int64)


def _level_up(n: np.ndarray, s: Settings) -> np.ndarray:
    return 1 + np.ceil(np.log(n / (s.least_count - s.discount)) / math.log(s.log_base) - 1e-9).astype(np.int64)


def _places(key: np.ndarray, level: np.ndarray | int, size: np.ndarray | int, s: Settings) -> np.ndarray:
    """Bit places of entries in their block: one row for each probe."""
    one = mix(key + np.asarray(level, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    two = mix(one ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    return np.stack([(one + np.uint64(i) * two) % np.asarray(size, np.uint64) for i in range(s.probes)])


def _block_of(key: np.ndarray, n_blocks: int) -> np.ndarray:
    return (mix(key ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(n_blocks)).astype(np.int64)


def build_blocks(grams: DataFrame, n_blocks: int, s: Settings) -> DataFrame:
    """``block``, ``bits``: the log-frequency Bloom filter of all pairs and histories, block by block."""
    pairs = grams.where(F.col("kind") == 2).select("key", "n")
    history = F.col("key").bitwiseAND(F.lit(int(_HISTORY_MASK) - (1 << 64)))
    # a history may have very many pairs: its sum is formed partly before the shuffle
    floor_ = F.lit(float(s.least_count)) * F.pow(F.lit(s.log_base), F.floor(F.log(F.col("n") / s.least_count) / math.log(s.log_base) + 1e-9))
    kept = pairs.groupBy(history.alias("key")).agg(F.sum(floor_ - s.discount).alias("kept"))
    entries = pairs.select("key", F.col("n").cast("double").alias("x"), F.lit(True).alias("down")).union(
        kept.select("key", "kept", F.lit(False)))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)
            down = batch.column("down").to_numpy(zero_copy_only=False)
            x = batch.column("x").to_numpy()
            key = np.where(down, key, history_key(key))
            level = np.where(down, _level_down(np.maximum(x, s.least_count), s), _level_up(x, s))
            yield pa.RecordBatch.from_arrays([pa.array(_block_of(key, n_blocks)), pa.array(key.view(np.int64)), pa.array(level)],
                                             names=["block", "key", "level"])

    def build(group: pa.Table) -> pa.Table:
        key = group.column("key").to_numpy().view(np.uint64)
        level = group.column("level").to_numpy()
        size = max(64, -(-int(level.sum()) * s.bits // 64) * 64)
        bits = np.zeros(size, np.uint8)
        for q in range(1, int(level.max()) + 1):
            at = level >= q
            bits[_places(key[at], q, size, s)] = 1
        block = group.column("block")[0].as_py()
        return pa.table({"block": pa.array([block], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return entries.mapInArrow(enter, "block long, key long, level long").groupBy("block").applyInArrow(build, "block long, bits binary")


@dataclass
class Model:
    total: int
    vocabulary: int
    n_blocks: int
    blocks_per_segment: int
    word_segments: int
    words: list[Broadcast]
    filters: list[Broadcast]
    settings: Settings


def _segment(rows: DataFrame, spark: SparkSession, pack) -> Broadcast:
    return spark.sparkContext.broadcast(pack(rows.toArrow()))


def _word_segment(key: np.ndarray, n: int) -> np.ndarray:
    return (mix(key) >> np.uint64(40)).astype(np.int64) % n


def fit_model(train: DataFrame, text: str, settings: Settings | None = None) -> Model:
    """Count, build and broadcast, one segment at a time."""
    s = settings or Settings()
    spark = train.sparkSession
    grams = materialize(count_grams(train, text).where((F.col("kind") == 1) | (F.col("n") >= s.least_count)), "grams", ("kind",))
    words = grams.where("kind = 1").select("key", "n")
    size = grams.agg(F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("total"), F.sum((F.col("kind") == 1).cast("long")).alias("words"),
                     F.sum((F.col("kind") == 2).cast("long")).alias("pairs")).first()
    total, vocabulary, pairs = size["total"] or 0, size["words"] or 0, size["pairs"] or 0
    n_blocks = max(1, -(-pairs // s.block_pairs))
    filters = materialize(build_blocks(grams, n_blocks, s), "filter")
    per = max(1, s.segment_pairs // s.block_pairs)

    def pack_filter(first: int):
        def pack(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            begins, sizes = np.zeros(per, np.int64), np.zeros(per, np.int64)
            parts, at = [], 0
            for block, bits in zip(t.column("block").to_pylist(), t.column("bits"), strict=True):
                part = np.frombuffer(bits.as_buffer(), np.uint8)
                begins[block - first], sizes[block - first] = at, 8 * len(part)
                parts.append(part)
                at += len(part)
            return begins, sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return pack

    def pack_words(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, n = t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy()
        order = np.argsort(key)
        return key[order], n[order].astype(np.min_scalar_type(int(n.max())) if len(n) else np.int64)

    n_words = max(1, -(-vocabulary // s.segment_words))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _word_segment(batch.column("key").to_numpy().view(np.uint64), n_words)
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], names=["segment", "key", "n"])

    marked = words.mapInArrow(mark, "segment long, key long, n long")
    return Model(
        total, vocabulary, n_blocks, per, n_words,
        [_segment(marked.where(F.col("segment") == i).select("key", "n"), spark, pack_words) for i in range(n_words)],
        [_segment(filters.where((F.col("block") >= i) & (F.col("block") < i + per)), spark, pack_filter(i)) for i in range(0, n_blocks, per)],
        s)


def _drop(b: Broadcast) -> None:
    """Free a broadcast in this worker; its file stays on the executor."""
    vars(b).pop("_value", None)


def _lookup(segment: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> np.ndarray:
    keys, n = segment
    if not len(keys):
        return np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, n[at], 0).astype(np.int64)


def probe_levels(segment: tuple[np.ndarray, np.ndarray, np.ndarray], block: np.ndarray, key: np.ndarray, s: Settings) -> np.ndarray:
    """Level of each key: the last of the levels 1, 2, ... that is found before the first miss."""
    begins, sizes, data = segment
    level = np.zeros(len(key), np.int64)
    at = np.flatnonzero(sizes[block] > 0)
    q = 1
    while len(at):
        places = _places(key[at], q, sizes[block[at]], s)
        byte = begins[block[at]] + (places >> np.uint64(3)).astype(np.int64)
        hit = ((data[byte] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
        at = at[hit]
        level[at] = q
        q += 1
    return level


def score_texts(docs: DataFrame, text: str, model: Model, id_column: str = "doc_id") -> DataFrame:
    """Per row: id, ``n_tokens``, ``n_known``, ``base_score`` and ``score``; texts are read once and not moved."""
    s = model.settings

    def counts(key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        part = _word_segment(key, model.word_segments)
        for i, b in enumerate(model.words):
            own = np.flatnonzero(part == i) if model.word_segments > 1 else slice(None)
            out[own] = _lookup(b.value, key[own])
            if model.word_segments > 1:
                _drop(b)
        return out

    def levels(key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        block = _block_of(key, model.n_blocks)
        part = block // model.blocks_per_segment
        for i, b in enumerate(model.filters):
            own = np.flatnonzero(part == i)
            out[own] = probe_levels(b.value, block[own] - i * model.blocks_per_segment, key[own], s)
            if len(model.filters) > 1:
                _drop(b)
        return out

    def score_group(tokens: list[Tokens], texts: int) -> tuple[np.ndarray, ...]:
        word = np.concatenate([t.word for t in tokens])
        history = np.concatenate([t.history for t in tokens])
        owner = np.concatenate([t.owner for t in tokens])
        seen, where = np.unique(np.concatenate([word, history]), return_inverse=True)
        c = counts(seen)
        # every text has one beginning, as it has one end
        c_history = np.where(seen == BEGIN, c_begin, c)
        kept_level = levels(history_key(seen))
        kept = np.where(kept_level > 0, (s.least_count - s.discount) * s.log_base ** (kept_level - 1.0), 0.0)
        w, h = where[: len(word)], where[len(word) :]
        base = np.log10((c + 0.5) / (model.total + 0.5 * (model.vocabulary + 1))) if model.total else np.zeros(len(seen))
        pairs, pair_at = np.unique(pair_key(history, word), return_inverse=True)
        first = np.zeros(len(pairs), np.int64)
        first[pair_at] = np.arange(len(word))
        # a known pair has a known word and history: others are not probed
        able = (c[w[first]] > 0) & (c_history[h[first]] > 0) & (kept[h[first]] > 0)
        level = np.zeros(len(pairs), np.int64)
        level[able] = levels(pairs[able])
        n_pair = np.where(level > 0, s.least_count * s.log_base ** (level - 1.0), 0.0)
        n_history = c_history[h[first]].astype(float)
        more = np.clip(n_pair - s.discount, 0, None)
        spare = np.clip(n_history - kept[h[first]], s.discount, None)
        p = np.where(n_history > 0, (more + spare * 10.0 ** base[w[first]]) / np.maximum(n_history, more + spare), 10.0 ** base[w[first]])
        score = np.log10(p)[pair_at] if model.total else np.zeros(len(word))
        total = lambda x: np.bincount(owner, weights=x, minlength=texts)
        return np.bincount(owner, minlength=texts), total(c[w] > 0).astype(np.int64), total(base[w]), total(score)

    c_begin = 0
    if model.total:
        # number of training texts: count of the end token
        end = np.array([END])
        segment = model.words[int(_word_segment(end, model.word_segments)[0])].value
        c_begin = int(_lookup(segment, end)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[Tokens] = []
            size = first = 0
            columns: list[tuple[np.ndarray, ...]] = []
            last = 0
            for b in blocks(batch.column("text")):
                t = block_tokens(b)
                held.append(Tokens(t.word, t.history, t.owner + (b.first - first)))
                size += len(t.word)
                last = b.last
                if size >= s.group_tokens:
                    columns.append(score_group(held, last - first))
                    held, size, first = [], 0, last
            if held:
                columns.append(score_group(held, last - first))
            if not columns:
                continue
            out = [pa.array(np.concatenate(x)) for x in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *out], names=["id", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("id", id_column)


def held_out_by_id(column: str = "doc_id"):
    return F.coalesce(id_share(F.col(column), 5) == 1, F.lit(False))


def score_by_model(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", settings: Settings | None = None) -> DataFrame:
    """Fit on the rows that are not held out and score all."""
    model = fit_model(docs.where(~held_out_by_id(id_column)), text, settings)
    return score_texts(docs, text, model, id_column).withColumn("held_out", held_out_by_id(id_column)).withColumn(
        "train_tokens", F.lit(model.total).cast("long"))
