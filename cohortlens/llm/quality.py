"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

1. Every text becomes a few document statistics (word lengths, case, kinds of
   signs, repetition of words and lines).
2. Statistics are standardised and mapped to random cosines. Their inner products
   approximate a Gaussian kernel of the standardised statistics.
3. Each partition sums its own normal equations, one set per fold of the labelled
   rows; sums are added in a tree. Data never leaves the partitions, the sums have
   a fixed size.
4. The ridge of all folds but one scores the labelled rows of that fold. These
   held-out scores are tallied on a fixed grid and pooled to a monotone curve.
5. The ridge of all folds scores every text, the curve turns scores to shares.

Defined cases: a missing or empty text has all statistics zero and is scored like
any other; a missing ``doc_id`` joins no label; several labels of a document count
once each; labels other than 0 and 1 are ignored; without any label every score is
0.5; with labels of one kind only, every score is that label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.tables import id_share
from cohortlens.llm.text import Block, blocks, mix, parts
from cohortlens.session import materialize

STATISTICS = (
    "log_chars", "log_words", "word_length", "long_words", "capitals", "digits", "marks", "odd_marks", "bars",
    "exclamations", "spaces", "newlines", "beyond_ascii", "distinct_words", "top_word", "line_length", "repeated_lines",
    "sign_ended_words", "all_capital_words",
)

#: fixed classes of single bytes
_CAPITAL, _SMALL, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_CAPITAL[65:91] = _SMALL[97:123] = _DIGIT[48:58] = True
_SPACE = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
_ASCII = np.arange(256) < 128
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_MARK = _ASCII & ~_CAPITAL & ~_SMALL & ~_DIGIT & ~_SPACE
_ODD = np.isin(np.arange(256), [ord(c) for c in "#$%&*@^~<>{}[]\\_=+"])


def block_statistics(b: Block) -> np.ndarray:
    """One row of ``STATISTICS`` per text of the block."""
    data, n = b.data, b.n
    size = b.per_text(~_CONTINUES[data])
    chars = np.maximum(size, 1)
    share = lambda flags: b.per_text(flags[data]) / chars
    starts, stops, owner = b.words()
    n_words = np.bincount(owner, minlength=n)
    words = np.maximum(n_words, 1)
    per_word = lambda x: np.bincount(owner, weights=x, minlength=n) / words
    length = stops - starts
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SMALL[data], out=before[1:])
    small = before[stops] - before[starts]
    np.cumsum(_CAPITAL[data], out=before[1:])
    capital = before[stops] - before[starts]
    low = b.lowered()
    key = mix(low.hashes(starts, stops) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at, times = np.unique(key, return_index=True, return_counts=True)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner[at], times)
    l_starts, l_stops, l_owner = b.lines()
    n_lines = np.bincount(l_owner, minlength=n)
    lines = np.maximum(n_lines, 1)
    l_key = mix(low.hashes(l_starts, l_stops) + l_owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, l_at = np.unique(l_key, return_index=True)
    last = data[stops - 1] if len(stops) else data[:0]
    columns = {
        "log_chars": np.log1p(size),
        "log_words": np.log1p(n_words),
        "word_length": np.log1p(per_word(length)),
        "long_words": per_word(length > 15),
        "capitals": share(_CAPITAL),
        "digits": share(_DIGIT),
        "marks": share(_MARK),
        "odd_marks": share(_ODD),
        "bars": share(np.arange(256) == ord("|")),
        "exclamations": share(np.arange(256) == ord("!")),
        "spaces": share(_SPACE),
        "newlines": share(np.arange(256) == 10),
        "beyond_ascii": share(~_ASCII & ~_CONTINUES),
        "distinct_words": np.bincount(owner[at], minlength=n) / words,
        "top_word": top / words,
        "line_length": np.log1p(n_words / lines),
        "repeated_lines": 1 - np.bincount(l_owner[l_at], minlength=n) / lines * (n_lines > 0) - (n_lines == 0),
        "sign_ended_words": per_word(_ODD[last] | (last == ord("!"))),
        "all_capital_words": per_word((capital > 1) & (small == 0)),
    }
    return np.column_stack([columns[c] for c in STATISTICS])


def document_statistics(docs: DataFrame, text: str = "text", into: str = "stats") -> DataFrame:
    """Put an array of the text's statistics in place of the text; other columns stay."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != text] + [T.StructField(into, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = np.zeros((batch.num_rows, len(STATISTICS)))
            for b in blocks(batch.column(text)):
                rows[b.first : b.last] = block_statistics(b)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS)
            stats = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))
            kept = [i for i, name in enumerate(batch.schema.names) if name != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), stats],
                                             names=[*(batch.schema.names[i] for i in kept), into])

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class QualityModel:
    """Everything needed to score; its size depends on ``features`` and ``grid`` only."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    curve_x: np.ndarray
    curve_y: np.ndarray

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.centre) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([waves, np.ones(len(stats))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.curve_x, self.curve_y), 0.0, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def pool_monotone(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit of means that come in order, with weights."""
    out: list[list[float]] = []
    for w, m in zip(weight, mean, strict=True):
        out.append([w, m, 1])
        while len(out) > 1 and out[-2][1] >= out[-1][1]:
            w2, m2, k2 = out.pop()
            w1, m1, k1 = out[-1]
            out[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), k1 + k2]
    return np.concatenate([np.full(k, m) for _, m, k in out]) if out else np.zeros(0)


def fit_quality(stats: DataFrame, labels: DataFrame, id_column: str, label_column: str, *, folds: int = 4,
                features: int = 192, bandwidth: float = 6.0, ridge: float = 1e-3, grid: int = 2048, seed: int = 7) -> QualityModel:
    """Fit on the labelled rows of ``stats`` (id and ``stats`` columns).

    ``labels`` holds one row per label; the caller leaves out rows that must not be learned from.
    """
    known = labels.where(F.col(label_column).isin(0, 1)).select(
        F.col(id_column).alias("id"), F.col(label_column).cast("double").alias("y"))
    rows = stats.select(F.col(id_column).alias("id"), "stats").join(known, "id").select(
        "stats", "y", F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int").alias("fold"))
    k = len(STATISTICS)
    shape = stats.select(*(F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(k)),
                         *(F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(k))).first()
    centre = np.array([shape[f"m{i}"] or 0.0 for i in range(k)])
    scale = np.array([shape[f"s{i}"] or 0.0 for i in range(k)])
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(seed)
    frame = QualityModel(centre, scale, rng.normal(size=(k, features)) / bandwidth, rng.uniform(0, 2 * np.pi, features),
                         np.zeros(features + 1), np.array([0.0]), np.array([0.5]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((folds, features + 1, features + 2))
        seen = np.zeros(folds)
        for batch in batches:
            y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            x = frame.cosines(_matrix(batch.column("stats")))
            for f in range(folds):
                own = x[fold == f]
                gram[f, :, :-1] += own.T @ own
                gram[f, :, -1] += own.T @ y[fold == f]
                seen[f] += len(own)
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary())], names=["sums"])

    # partial sums have one size whatever the data; they are added in a tree before the last few reach the driver
    parts = rows.mapInArrow(sums, "sums binary").rdd.map(lambda r: np.frombuffer(bytes(r["sums"])))
    total = parts.treeAggregate(0.0, lambda a, b: a + b, lambda a, b: a + b, depth=3)
    gram = np.zeros((folds, features + 1, features + 2)) + np.reshape(total, (folds, features + 1, features + 2)) if np.ndim(total) else None
    if gram is None:
        return frame

    def solve(g: np.ndarray) -> np.ndarray:
        # the constant term is not shrunk
        penalty = np.eye(features + 1) * max(ridge * g[-1, -2], 1e-6)
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(g[:, :-1] + penalty, g[:, -1])

    whole = gram.sum(0)
    held_out = np.stack([solve(whole - gram[f]) if whole[-1, -2] > gram[f, -1, -2] else solve(whole) for f in range(folds)])
    low, high = -0.5, 1.5

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((grid, 3))
        for batch in batches:
            y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            s = (frame.cosines(_matrix(batch.column("stats"))) * held_out[fold]).sum(1)
            cell = np.clip(((s - low) / (high - low) * grid).astype(int), 0, grid - 1)
            for i, w in enumerate((np.ones(len(y)), y, s)):
                tally[:, i] += np.bincount(cell, weights=w, minlength=grid)
        at = np.flatnonzero(tally[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(tally[at, i]) for i in range(3))], names=["cell", "n", "y", "s"])

    tally = rows.mapInArrow(cells, "cell long, n double, y double, s double").groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("s").alias("s")).toPandas().sort_values("cell")
    n, y, s = (tally[c].to_numpy() for c in ("n", "y", "s"))
    fitted = pool_monotone(n, y / n)
    # one point per pooled step, at the mean score of its rows; scores between points are interpolated
    step = np.cumsum(np.r_[True, np.diff(fitted) > 0]) - 1
    n_step = np.bincount(step, weights=n)
    curve_x = np.bincount(step, weights=s) / n_step
    curve_y = np.bincount(step, weights=y) / n_step
    return QualityModel(frame.centre, frame.scale, frame.directions, frame.phases, solve(whole), curve_x, curve_y)


def score_statistics(stats: DataFrame, model: QualityModel, into: str = "score", column: str = "stats") -> DataFrame:
    """Replace the array of statistics by the calibrated score."""
    schema = T.StructType([f for f in stats.schema.fields if f.name != column] + [T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [i for i, name in enumerate(batch.schema.names) if name != column]
            score = pa.array(model.score(_matrix(batch.column(column))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), score],
                                             names=[*(batch.schema.names[i] for i in kept), into])

    return stats.mapInArrow(run, schema)


def learnable(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Labels outside the held-out fifth."""
    return labels.where(F.coalesce(id_share(F.col(id_column), 5) != 0, F.lit(False)))


def score_quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_column: str = "doc_id",
                  label_column: str = "quality", **settings) -> DataFrame:
    """Score every row: id, ``held_out`` and ``score``. Texts are read once; the statistics are kept for the rest."""
    stats = materialize(document_statistics(docs.select(id_column, text), text), "quality-stats")
    model = fit_quality(stats, learnable(labels, id_column), id_column, label_column, **settings)
    return score_statistics(stats, model).select(
        id_column, F.coalesce(id_share(F.col(id_column), 5) == 0, F.lit(False)).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, *, text: str = "text",
              id_column: str = "doc_id", **settings) -> DataFrame:
    """Rows whose score reaches ``least``, with all their columns; the model is fitted on the labelled ones.

    Texts pass through a worker once, in which they are measured, scored and kept or left out.
    """
    sized = materialize(document_statistics(docs.select(id_column, text), text), "quality-stats")
    model = fit_quality(sized, learnable(labels, id_column), id_column, "quality", **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 256):
            good = np.zeros(batch.num_rows, bool)
            for b in blocks(batch.column(text)):
                good[b.first : b.last] = model.score(block_statistics(b)) >= least
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
