"""Logistic regressions of all scopes, outcomes and training parts, fitted together.

A study needs hundreds of them: per scope and outcome one on all training rows, one per
cross-validation fold, two halves of every part that a calibrator is fitted on. One after
the other, each is a chain of jobs over nearly the same rows. Here a Newton step of all of
them is one job: a task multiplies its rows' features once per scope and adds up, for every
fit whose training part a row belongs to, gradient and Gram matrix; a fit's sums meet in one
group, which takes the step and returns its coefficients. So the driver holds coefficients
only (fits x features), and the number of jobs is that of the slowest fit's steps.

The objective is the usual one: log loss summed over the rows plus ``|w|^2 / (2 C)``, the
intercept without penalty. Steps that don't lower it are halved.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.features import present
from cohortlens.operators.models import ALGORITHMS, Fitted, ModelSettings, score_col
from cohortlens.operators.training import FoldPlan, Part, Scope
from cohortlens.operators.votes import p_col, yhat_col
from cohortlens.session import materialize

NAME = "log-reg"
#: fold number of rows outside a scope
OUTSIDE = 255
#: rows multiplied at once
STRIP = 2048
#: a step that promises less than this is the last one; the next would promise its square
SETTLED = 1e-9


def study_parts(
    plan: FoldPlan, scopes: Sequence[Scope], outcomes: Sequence[str], calibrated_cv: bool, ensemble_cv: bool
) -> list[Part]:
    """The parts that :func:`train_scope` and the vote's cross-validation ask for; those of one class are left out."""
    out = []
    for scope in scopes:
        for outcome in outcomes:
            at = (scope.attribute, scope.grp, outcome)
            wanted = [Part(*at, "final")]
            wanted += [Part(*at, "cv", -1, f) for f in range(plan.k("cv", scope))]
            wanted += [Part(*at, "inner", h, i) for h in [-1, *(range(plan.sizes["outer"]) if calibrated_cv else ())] for i in range(2)]
            wanted += [Part(*at, "outer", -1, f) for f in range(plan.sizes["outer"])] if ensemble_cv else []
            out += [p for p in wanted if min(part_counts(plan, scope, p)) > 0]
    return out


def part_counts(plan: FoldPlan, scope: Scope, part: Part) -> tuple[int, int]:
    if part.name == "final":
        return plan.total(scope, part.outcome)
    return plan.rest(part.name, scope, part.outcome, part.fold, part.held_out)


def fold_slots(plan: FoldPlan) -> list[tuple[str, int]]:
    """The fold numberings that a row carries per scope and outcome."""
    nested = sorted({key[4] for key in plan.ends if key[0] == "inner"})
    return [("cv", -1), ("outer", -1), *[("inner", h) for h in nested]]


def numbered_rows(
    train: DataFrame, features: Sequence[str], outcomes: Sequence[str], plan: FoldPlan, scopes: Sequence[Scope], keep: Sequence[str] = ("row_id",),
) -> DataFrame:
    """``keep``, ``x`` (missing values are NaN), ``y`` and ``folds``: one byte per scope, outcome and numbering.

    A row's folds are found once, by comparing its order key with the ends in ``plan``.
    """
    slots = fold_slots(plan)
    ends = {
        (s, o, k, label): np.array(e, "S32")
        for s, scope in enumerate(scopes) for o, outcome in enumerate(outcomes) for k, (name, held) in enumerate(slots)
        for label, e in plan.ends.get((name, *scope.key, outcome, held), {}).items()
    }
    shape = (len(scopes), len(outcomes), len(slots))
    nan = F.lit(float("nan"))
    rows = train.select(
        *keep, "okey", F.array(*[F.coalesce(present(c), nan) for c in features]).alias("x"),
        F.array(*[F.col(o).cast("int") for o in outcomes]).alias("y"),
        F.array(*[F.lit(True) if s.group is None else F.coalesce(s.group.column(), F.lit(False)) for s in scopes]).alias("member"))
    schema = T.StructType([*[rows.schema[c] for c in keep], rows.schema["x"], rows.schema["y"], T.StructField("folds", T.BinaryType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = np.array(batch.column("okey").to_pylist(), "S32")
            y = batch.column("y").flatten().to_numpy().reshape(n, -1)
            member = batch.column("member").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            folds = np.full((n, *shape), OUTSIDE, np.uint8)
            for (s, o, k, label), e in ends.items():
                at = np.flatnonzero(member[:, s] & (y[:, o] == label))
                folds[at, s, o, k] = (key[at, None] > e[None, :]).sum(axis=1) if len(e) else 0
            flat = folds.reshape(n, -1)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], batch.column("x"), batch.column("y"),
                 pa.array([r.tobytes() for r in flat], pa.binary())], names=schema.names)

    return rows.mapInArrow(number, schema)


def _strips(batches: Iterator[pa.RecordBatch], shape: tuple[int, int, int]):
    """Batch, features, labels and folds of a few rows at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, STRIP):
            part = batch.slice(first, STRIP)
            n = part.num_rows
            x = part.column("x").flatten().to_numpy().reshape(n, -1)
            y = part.column("y").flatten().to_numpy().reshape(n, -1).astype(np.float64)
            folds = np.frombuffer(b"".join(part.column("folds").to_pylist()), np.uint8).reshape(n, *shape)
            yield part, x, y, folds


def _filled_with_one(x: np.ndarray, fill: np.ndarray) -> np.ndarray:
    return np.column_stack([np.where(np.isnan(x), fill, x), np.ones(len(x))])


def _trained(folds: np.ndarray, parts: Sequence[Part], slots: list[tuple[str, int]]) -> np.ndarray:
    """Which rows (of one scope and outcome) belong to which part."""
    out = np.ones((len(folds), len(parts)), bool)
    for i, p in enumerate(parts):
        if p.name == "final":
            continue
        if p.held_out >= 0:
            out[:, i] = folds[:, slots.index(("outer", -1))] != p.held_out
        out[:, i] &= folds[:, slots.index((p.name, p.held_out))] != p.fold
    return out


@dataclass
class _State:
    """Where the search of one part stands."""

    now: np.ndarray
    best: np.ndarray
    loss: float = np.inf
    done: bool = False


def _advance(state: _State, sums: np.ndarray, d: int, c: float) -> _State:
    """Take, or halve, a Newton step. ``sums``: loss, gradient, lower triangle of the Gram matrix."""
    ridge = np.full(d, 1.0 / c)
    ridge[-1] = 0.0
    loss = sums[0] + 0.5 * float(ridge @ state.now**2)
    if not loss <= state.loss + 1e-12 * abs(state.loss):
        now = (state.now + state.best) / 2
        still = np.abs(now - state.best).max() <= 1e-12 * max(1.0, np.abs(state.best).max())
        return _State(now, state.best, state.loss, bool(still))
    gradient = sums[1 : 1 + d] + ridge * state.now
    gram = np.zeros((d, d))
    low = np.tril_indices(d)
    gram[low] = sums[1 + d :]
    gram = gram + np.tril(gram, -1).T + np.diag(ridge)
    # columns differ by many orders of magnitude: scale the system to a unit diagonal
    scale = 1.0 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    scaled = gram * scale[:, None] * scale[None, :]
    step = scale * np.linalg.lstsq(scaled, scale * gradient, rcond=1e-14)[0]
    promise = float(gradient @ step)
    following = state.now - step
    if promise <= SETTLED:
        return _State(following, following, loss, True)
    return _State(following, state.now, loss, False)


def fit_together(
    rows: DataFrame, parts: Sequence[Part], scopes: Sequence[Scope], outcomes: Sequence[str], plan: FoldPlan,
    fill: Mapping[tuple[str, str], Sequence[float]], settings: ModelSettings = ModelSettings(),
) -> dict[Part, np.ndarray]:
    """Coefficients, the intercept last, of every part. ``rows`` come from :func:`numbered_rows` and are stored.

    ``fill`` has the value of every feature that stands for a missing one in a scope.
    """
    slots = fold_slots(plan)
    shape = (len(scopes), len(outcomes), len(slots))
    d = 1 + len(next(iter(fill.values())))
    fills = [np.array(fill[s.key], float) for s in scopes]
    place = {s.key: i for i, s in enumerate(scopes)}
    states = {i: _State(np.zeros(d), np.zeros(d)) for i in range(len(parts))}
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    after = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("now", T.ArrayType(T.DoubleType())),
                          T.StructField("best", T.ArrayType(T.DoubleType())), T.StructField("loss", T.DoubleType()),
                          T.StructField("done", T.BooleanType())])

    def step(open_: dict[int, _State]) -> list:
        cells: dict[tuple[int, int], list[int]] = {}
        for i in open_:
            p = parts[i]
            cells.setdefault((place[p.attribute, p.grp], outcomes.index(p.outcome)), []).append(i)
        weights = {cell: np.stack([open_[i].now for i in mine]) for cell, mine in cells.items()}

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low = np.tril_indices(d)
            totals = {i: np.zeros(1 + d + len(low[0])) for i in open_}
            for _, x, y, folds in _strips(batches, shape):
                for s in sorted({s for s, _ in cells}):
                    at = np.flatnonzero(folds[:, s, 0, 0] != OUTSIDE)
                    if not len(at):
                        continue
                    xs = _filled_with_one(x[at], fills[s])
                    pairs = xs[:, low[0]] * xs[:, low[1]]
                    for o in range(len(outcomes)):
                        mine = cells.get((s, o))
                        if not mine:
                            continue
                        trained = _trained(folds[at, s, o], [parts[i] for i in mine], slots)
                        margin = xs @ weights[s, o].T
                        p = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
                        label = y[at, o][:, None]
                        loss = np.logaddexp(0.0, margin) - label * margin
                        sums = np.hstack([
                            (loss * trained).sum(axis=0)[:, None], ((p - label) * trained).T @ xs, (p * (1 - p) * trained).T @ pairs])
                        for i, row in zip(mine, sums, strict=True):
                            totals[i] += row
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.int32()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))],
                names=schema.names)

        def advance(table: pa.Table) -> pa.Table:
            i = table["part"][0].as_py()
            sums = table["sums"].combine_chunks().flatten().to_numpy().reshape(len(table), -1).sum(axis=0)
            new = _advance(open_[i], sums, d, settings.logistic_c)
            lists = pa.list_(pa.float64())
            return pa.table({"part": pa.array([i], pa.int32()), "now": pa.array([new.now.tolist()], lists),
                             "best": pa.array([new.best.tolist()], lists), "loss": [new.loss], "done": [new.done]})

        return rows.mapInArrow(add_up, schema).groupBy("part").applyInArrow(advance, after).collect()

    for _ in range(settings.logistic_iterations):
        open_ = {i: s for i, s in states.items() if not s.done}
        if not open_:
            break
        for r in step(open_):
            states[r["part"]] = _State(np.array(r["now"]), np.array(r["best"]), r["loss"], r["done"])
    return {p: states[i].best for i, p in enumerate(parts)}


@dataclass(frozen=True)
class LinearFitted(Fitted):
    """A fitted logistic regression, scored by an expression over the features."""

    weights: tuple[float, ...] = ()

    def score(self, df: DataFrame, name: str | None = None) -> DataFrame:
        name = name or self.algorithm.name
        kept = df.columns
        *w, intercept = self.weights
        # a sum of plain products, which Spark compiles; functions over arrays are interpreted for every row
        values = "_linear_values"
        margin = reduce(lambda a, iv: a + F.get(values, F.lit(iv[0])) * F.lit(float(iv[1])), enumerate(w), F.lit(float(intercept)))
        out = df.withColumn(values, vector_to_array("features")).withColumn(score_col(name), margin)
        p = 1 / (1 + F.exp(-F.col(score_col(name))))
        return out.select(*kept, p.alias(p_col(name)), score_col(name), F.when(p > 0.5, 1).otherwise(0).alias(yhat_col(name)))


def fitted_models(coefficients: Mapping[Part, np.ndarray]) -> dict[tuple[str, Part], Fitted]:
    """As :func:`train_scope` takes them."""
    return {(NAME, p): LinearFitted(ALGORITHMS[NAME], None, None, tuple(w.tolist())) for p, w in coefficients.items()}


def held_out_scores(
    rows: DataFrame, coefficients: Mapping[Part, np.ndarray], scopes: Sequence[Scope], outcomes: Sequence[str], plan: FoldPlan,
    fill: Mapping[tuple[str, str], Sequence[float]],
) -> DataFrame:
    """Every row of every scope and outcome, scored by the fit that left out its cross-validation fold: one pass.

    ``row_id, attribute, grp, outcome, fold, y, p, yhat``; ``p`` is NaN where the other folds hold one class.
    """
    slots = fold_slots(plan)
    shape = (len(scopes), len(outcomes), len(slots))
    fills = [np.array(fill[s.key], float) for s in scopes]
    d = 1 + len(fills[0])
    weights = {}
    for s, scope in enumerate(scopes):
        for o, outcome in enumerate(outcomes):
            parts = [Part(*scope.key, outcome, "cv", -1, f) for f in range(plan.k("cv", scope))]
            weights[s, o] = np.stack([coefficients.get(p, np.full(d, np.nan)) for p in parts])
    types = [("row_id", rows.schema["row_id"].dataType), ("attribute", T.StringType()), ("grp", T.StringType()), ("outcome", T.StringType()),
             ("fold", T.IntegerType()), ("y", T.IntegerType()), ("p", T.DoubleType()), ("yhat", T.IntegerType())]
    schema = T.StructType([T.StructField(n, t) for n, t in types])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, y, folds in _strips(batches, shape):
            for s, scope in enumerate(scopes):
                at = np.flatnonzero(folds[:, s, 0, 0] != OUTSIDE)
                if not len(at):
                    continue
                xs = _filled_with_one(x[at], fills[s])
                ids = part.column("row_id").take(pa.array(at))
                for o, outcome in enumerate(outcomes):
                    fold = folds[at, s, o, slots.index(("cv", -1))].astype(np.int64)
                    margin = np.einsum("ij,ij->i", xs, weights[s, o][fold])
                    p = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([scope.attribute] * n), pa.array([scope.grp] * n), pa.array([outcome] * n), pa.array(fold.astype(np.int32)),
                         pa.array(y[at, o].astype(np.int32)), pa.array(p), pa.array((p > 0.5).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(score, schema)


def stored_rows(train: DataFrame, *arguments, **options) -> DataFrame:
    """:func:`numbered_rows`, written once and read by every step."""
    return materialize(numbered_rows(train, *arguments, **options), "numbered")

