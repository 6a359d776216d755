"""Cross-validation, final fits and calibration fits for one scope, sharing every fit that can be shared.

A scope is the whole population or a subgroup. Its vectors are cached once; the
independent fits are submitted from a small pool of driver threads, and each is a
distributed Spark job. Scores are collected side by side for all algorithms, so
the rows of a fold are read once, not once per algorithm.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import pairwise, permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.features import assemble, filled
from cohortlens.operators.models import Algorithm, Fitted, ModelSettings, fit, score_all, score_col
from cohortlens.operators.subgroups import ALL, Registry, Subgroup, member_pattern, spread_pattern
from cohortlens.operators.votes import p_col, yhat_col
from cohortlens.session import local_table, settled

Counts = dict[tuple, dict[int, int]]


@dataclass(frozen=True)
class Scope:
    attribute: str
    grp: str
    group: Subgroup | None = None

    @property
    def key(self) -> tuple[str, str]:
        return (self.attribute, self.grp)

    def rows(self, df: DataFrame) -> DataFrame:
        return df if self.group is None else df.where(self.group.column())


def scopes_of(registry: Registry, attributes: Iterable[str] | None = None) -> list[Scope]:
    return [Scope(ALL, ALL), *[Scope(g.attribute, g.name, g) for g in registry.active(attributes)]]


@dataclass(frozen=True)
class Part:
    """A training part: everyone in a scope, without outer fold ``held_out`` and without fold ``fold`` of ``name``."""

    attribute: str
    grp: str
    outcome: str
    name: str
    held_out: int = -1
    fold: int = -1


#: fits that were made beforehand, by algorithm and part
Ready = Mapping[tuple[str, Part], Fitted]


@dataclass
class FoldPlan:
    """Where the folds of every scope and outcome end, and how many rows of each class they hold.

    ``ends[(name, attribute, grp, outcome, held_out)][label]`` is a list of order keys.
    A few rows per scope, found for all scopes together.
    """

    sizes: Mapping[str, int]
    ends: dict[tuple, dict[int, list[str]]] = field(default_factory=dict)
    counts: Counts = field(default_factory=dict)

    def column(self, name: str, scope: Scope, outcome: str, key: str = "okey", held_out: int = -1) -> Column:
        """Fold number of a row: how many fold ends of its class lie before its key.

        A part without any row has no ends; its rows, of which there are none, are fold 0.
        """
        out: Column | None = None
        for label, ends in sorted(self.ends.get((name, *scope.key, outcome, held_out), {}).items()):
            number = reduce(lambda a, b: a + b, [F.when(F.col(key) > e, 1).otherwise(0) for e in ends])
            hit = F.col("y") == label
            out = F.when(hit, number) if out is None else out.when(hit, number)
        return F.lit(0) if out is None else out

    def count(self, name: str, scope: Scope, outcome: str, held_out: int, fold: int) -> tuple[int, int]:
        c = self.counts.get((name, *scope.key, outcome, held_out, fold), {})
        return c.get(0, 0), c.get(1, 0)

    def rest(self, name: str, scope: Scope, outcome: str, fold: int, held_out: int = -1) -> tuple[int, int]:
        """Class counts of all folds but one."""
        others = [self.count(name, scope, outcome, held_out, f) for f in range(self.k(name, scope)) if f != fold]
        return sum(c[0] for c in others), sum(c[1] for c in others)

    def total(self, scope: Scope, outcome: str) -> tuple[int, int]:
        both = [self.count("inner", scope, outcome, -1, f) for f in range(2)]
        return both[0][0] + both[1][0], both[0][1] + both[1][1]

    def k(self, name: str, scope: Scope) -> int:
        if name == "cv":
            return self.sizes["population" if scope.attribute == ALL else "subgroup"]
        return self.sizes[name]


#: hexadecimal digits of the order key by which one pass counts, and rows under a prefix that needn't be told apart by another pass
PREFIX_DIGITS, FEW_ROWS = 3, 4096
SCOPE_KEYS = ["attribute", "grp", "outcome", "y"]


def _dealt(position: int, k: int, i: int) -> int:
    """How many of the positions 0..position-1 go to the first ``i`` of ``k`` folds when dealt in turn."""
    return position // k * i + min(position % k, i)


def _end_ranks(sizes: Mapping[int, int], order: Sequence[int], k: int) -> dict[int, list[int]]:
    """Ranks, per class, of the last rows of folds 0..k-2, and its size: classes are dealt one after the other."""
    out, start = {}, 0
    for label in order:
        stop = start + sizes[label]
        out[label] = [_dealt(stop, k, i) - _dealt(start, k, i) for i in range(1, k)] + [sizes[label]]
        start = stop
    return out


class _Without:
    """A class without the rows of one block of ranks: its size, and ranks in it as ranks in the whole class."""

    def __init__(self, size: int, before: int, upto: int):
        self.before, self.gone, self.size = before, upto - before, size - (upto - before)

    def whole(self, rank: int) -> int:
        return rank if rank <= self.before else rank + self.gone


class _Ranks:
    """All ranks that the folds of one scope and outcome need, given its classes' sizes and first keys."""

    def __init__(self, classes: Mapping[int, tuple[int, int]], sizes: Mapping[str, int], whole: bool, nested: bool):
        self.sizes = {label: n for label, (n, _) in classes.items()}
        order = sorted(self.sizes, key=lambda label: (classes[label][1], label))
        k = {"cv": sizes["population" if whole else "subgroup"], "outer": sizes["outer"], "inner": 2}
        self.ends = {(name, -1): _end_ranks(self.sizes, order, k[name]) for name in k}
        self.parts: dict[int, dict[int, _Without]] = {}
        if nested:
            for h in range(sizes["outer"]):
                cut = {label: [0, *ends] for label, ends in self.ends["outer", -1].items()}
                part = {label: _Without(n, cut[label][h], cut[label][h + 1]) for label, n in self.sizes.items()}
                self.parts[h] = {label: w for label, w in part.items() if w.size}

    def halves(self, h: int, order: Sequence[int]) -> dict[int, list[int]]:
        """End ranks of the halves of the part without outer fold ``h``, as ranks in the whole class."""
        part = self.parts[h]
        inside = _end_ranks({label: w.size for label, w in part.items()}, order, 2)
        return {label: [part[label].whole(r) if r else 0 for r in ranks[:-1]] for label, ranks in inside.items()}

    def wanted(self) -> dict[int, set[int]]:
        """Per class, the ranks whose keys must be known; for a part, with either order of its classes."""
        out = {label: {r for ends in self.ends.values() for r in ends.get(label, [0])[:-1]} for label in self.sizes}
        for h, part in self.parts.items():
            for order in permutations(sorted(part)):
                for label, ranks in self.halves(h, order).items():
                    out[label].update(ranks)
            for label, w in part.items():
                out[label].add(w.whole(1))
        return {label: ranks - {0} for label, ranks in out.items()}


def _prefix_tree(
    rows: DataFrame, groups: Sequence[Subgroup], outcomes: Sequence[str], digits: int, prefixes: DataFrame | None = None
) -> DataFrame:
    """Rows and smallest key per scope, outcome, class and key prefix, counted per membership pattern first."""
    cut = F.substring("okey", 1, digits).alias("prefix")
    if prefixes is not None:
        short = prefixes.select(F.col("prefix").alias("_under")).distinct()
        rows = rows.withColumn("_under", F.substring("okey", 1, digits - PREFIX_DIGITS)).join(short, "_under", "left_semi")
    first = F.conv(F.substring("okey", 1, 15), 16, 10).cast("long")
    cells = rows.groupBy("_in", *outcomes, cut).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    labels = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("int").alias("y")) for o in outcomes])
    long = spread_pattern(cells.withColumn("_e", F.explode(labels)).select("_in", "prefix", "n", "first", "_e.*"), groups, "_in")
    return settled(long.groupBy(*SCOPE_KEYS, "prefix").agg(F.sum("n").alias("n"), F.min("first").alias("first")), "prefixes")


def _keys_at_ranks(
    rows: DataFrame, groups: Sequence[Subgroup], outcomes: Sequence[str], tree: DataFrame, wanted: DataFrame
) -> dict[tuple, str]:
    """The order key at every wanted rank, by ``(attribute, grp, outcome, y, rank)``.

    The tree of prefixes is refined below the ranks only, until few rows share a prefix;
    those rows are then numbered.
    """
    by = Window.partitionBy(*SCOPE_KEYS).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    below, digits = wanted.withColumn("inside", F.col("rank")).withColumn("_under", F.lit("")), PREFIX_DIGITS
    while True:
        counted = tree.withColumn("_under", F.substring("prefix", 1, digits - PREFIX_DIGITS))
        upto = F.sum("n").over(by if digits == PREFIX_DIGITS else Window.partitionBy(*SCOPE_KEYS, "_under").orderBy("prefix").rowsBetween(
            Window.unboundedPreceding, 0))
        hit = counted.withColumn("upto", upto).join(below, [*SCOPE_KEYS, "_under"]).where(
            (F.col("inside") > F.col("upto") - F.col("n")) & (F.col("inside") <= F.col("upto")))
        hit = settled(hit.select(*SCOPE_KEYS, "prefix", "rank", "n", (F.col("inside") - F.col("upto") + F.col("n")).alias("inside")))
        widest = hit.agg(F.max("n")).first()[0]
        if widest is None or widest <= FEW_ROWS or digits > 30 - PREFIX_DIGITS:
            break
        digits += PREFIX_DIGITS
        tree = _prefix_tree(rows, groups, outcomes, digits, hit)
        below = hit.select(*SCOPE_KEYS, F.col("prefix").alias("_under"), "rank", "inside")
    cut = F.substring("okey", 1, digits).alias("prefix")
    near = rows.select("okey", "_in", *outcomes, cut).join(hit.select("prefix").distinct(), "prefix", "left_semi")
    labels = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("int").alias("y")) for o in outcomes])
    near = near.withColumn("_e", F.explode(labels)).select("okey", "_in", "prefix", "_e.*")
    number = F.row_number().over(Window.partitionBy(*SCOPE_KEYS, "prefix").orderBy("okey"))
    asked = hit.groupBy(*SCOPE_KEYS, "prefix").agg(F.collect_list(F.struct("inside", "rank")).alias("asked"))
    found = spread_pattern(near, groups, "_in").join(asked, [*SCOPE_KEYS, "prefix"]).withColumn("_rn", number)
    found = found.withColumn("_hit", F.explode(F.filter("asked", lambda a: a["inside"] == F.col("_rn"))))
    return {(*(r[c] for c in SCOPE_KEYS), r["rank"]): r["okey"] for r in found.select(*SCOPE_KEYS, "_hit.rank", "okey").collect()}


def plan_folds(
    train: DataFrame, registry: Registry, outcomes: Sequence[str], sizes: Mapping[str, int], seed: int,
    attributes: Sequence[str] | None = None, nested: bool = True,
) -> FoldPlan:
    """Find all fold ends: ``cv`` folds, ``outer`` folds of the calibrated CV, ``inner`` halves of both.

    ``train`` carries the order key as ``okey``. Two passes over its rows serve all scopes
    and outcomes: one counts them by membership pattern, labels and key prefix, which gives
    every class its size; from the sizes follow the ranks of all ends, those of the nested
    halves included, as folds are blocks of ranks. The other looks up the keys at these
    ranks, a few per scope, below the prefixes that hold them. On large tables a pass more
    refines these prefixes.
    """
    plan = FoldPlan(sizes)
    groups = registry.active(attributes)
    rows = train.select("okey", *outcomes, (member_pattern(groups) if groups else F.lit("")).alias("_in"))
    tree = _prefix_tree(rows, groups, outcomes, PREFIX_DIGITS)
    classes: dict[tuple, dict[int, tuple[int, int]]] = {}
    for r in tree.groupBy(*SCOPE_KEYS).agg(F.sum("n").alias("n"), F.min("first").alias("first")).collect():
        classes.setdefault((r["attribute"], r["grp"], r["outcome"]), {})[r["y"]] = (r["n"], r["first"])
    ranks = {at: _Ranks(c, sizes, at[0] == ALL, nested) for at, c in classes.items()}
    wanted = [(*at, label, rank) for at, mine in ranks.items() for label, of in mine.wanted().items() for rank in sorted(of)]
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in SCOPE_KEYS[:3]], T.StructField("y", T.IntegerType()),
                           T.StructField("rank", T.LongType())])
    keys = _keys_at_ranks(rows, groups, outcomes, tree, local_table(train.sparkSession, wanted, schema))

    for at, mine in ranks.items():
        key = lambda label, rank, at=at: keys[(*at, label, rank)] if rank else ""

        def put(name: str, h: int, label: int, ends: Sequence[int], upto: Sequence[int], at=at, key=key) -> None:
            plan.ends.setdefault((name, *at, h), {})[label] = [key(label, r) for r in ends]
            for fold, (a, b) in enumerate(pairwise([0, *upto])):
                plan.counts.setdefault((name, *at, h, fold), {})[label] = b - a

        for (name, h), ends in mine.ends.items():
            for label, of in ends.items():
                put(name, h, label, of[:-1], of)
        for h, part in mine.parts.items():
            order = sorted(part, key=lambda label: (key(label, part[label].whole(1)), label))
            inside = _end_ranks({label: w.size for label, w in part.items()}, order, 2)
            for label, of in mine.halves(h, order).items():
                put("inner", h, label, of, inside[label])
    return plan


@dataclass
class ScopeScores:
    """What training one scope and outcome yields; all lazy frames over the cached vectors."""

    cv: DataFrame
    calibration_fit: DataFrame | None
    calibration_apply: DataFrame | None
    test: DataFrame
    final: dict[str, Fitted]


def vectors(
    df: DataFrame, features: Sequence[str], numeric: Sequence[str], fill: Mapping[str, float], keep: Sequence[str],
) -> DataFrame:
    """Imputed feature vectors with the order key. ``fill`` was fitted on the scope's training rows."""
    imputed = dict(zip(numeric, filled(numeric, fill)))
    wide = df.select(*keep, "okey", *[imputed.get(c, F.col(c)) for c in features])
    return assemble(wide, features).select(*keep, "okey", "features")


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _tag(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def _submit(pool: ThreadPoolExecutor, ready: Ready | None, at: Part, fit, a: Algorithm, *arguments) -> Future:
    """A fit that is ready, or one that the pool makes."""
    known = (ready or {}).get((a.name, at))
    if known is None:
        return pool.submit(fit, a, *arguments)
    done: Future = Future()
    done.set_result(known)
    return done


def train_scope(
    scope: Scope, outcome: str, train: DataFrame, test: DataFrame, plan: FoldPlan, algos: Sequence[Algorithm],
    settings: ModelSettings, n_features: int, pool: ThreadPoolExecutor, calibrated_cv: bool = True,
    keep_test: Sequence[str] = (), ready: Ready | None = None,
) -> ScopeScores:
    """Fit everything one scope and outcome needs, but for what is ``ready``.

    Per algorithm: k CV fits, one final fit, two fits on the halves for the final
    calibrators and, with ``calibrated_cv``, two per outer fold. Both calibrators
    share the same base fits. ``train`` carries ``row_id, y, okey, features``.
    """
    k, n_outer = plan.k("cv", scope), plan.sizes["outer"]
    cv_fold = plan.column("cv", scope, outcome)
    outer_fold = plan.column("outer", scope, outcome)
    inner_fold = {h: plan.column("inner", scope, outcome, held_out=h)
                  for h in [-1, *(range(n_outer) if calibrated_cv else ())]}
    part = lambda h: train if h < 0 else train.where(outer_fold != h)

    def start(a: Algorithm, rows: DataFrame, counts: tuple[int, int], *named) -> Future:
        at = Part(*scope.key, outcome, *named)
        return _submit(pool, ready, at, fit, a, rows, counts, n_features, settings)

    cv = {(f, a.name): start(a, train.where(cv_fold != f), plan.rest("cv", scope, outcome, f), "cv", -1, f)
          for f in range(k) for a in algos}
    final = {a.name: start(a, train, plan.total(scope, outcome), "final") for a in algos}
    halves = {(h, i, a.name): start(a, part(h).where(inner_fold[h] != i), plan.rest("inner", scope, outcome, i, h), "inner", h, i)
              for h in inner_fold for i in range(2) for a in algos}
    cv, final, halves = ({key: job.result() for key, job in jobs.items()} for jobs in (cv, final, halves))

    tags = {"attribute": scope.attribute, "grp": scope.grp, "outcome": outcome}
    names = [a.name for a in algos]
    scored = [c for m in names for c in (p_col(m), yhat_col(m))]
    cv_rows = _union([
        _tag(score_all([cv[f, m] for m in names], train.where(cv_fold == f)), fold=f) for f in range(k)
    ]).select("row_id", "fold", "y", *scored)

    def half_scores(h: int, rows: DataFrame, i: int) -> DataFrame:
        return score_all([halves[h, i, m] for m in names], rows)

    fit_rows = _union([
        _tag(half_scores(h, part(h).where(inner_fold[h] == i), i), held_out=h, inner=i)
        for h in inner_fold for i in range(2)
    ]).select("row_id", "held_out", "inner", "y", *[score_col(m) for m in names])

    def with_halves(h: int, rows: DataFrame) -> DataFrame:
        """The scores of both half models side by side, as ``h0__m`` and ``h1__m``."""
        for i in range(2):
            for m in names:
                kept, name = rows.columns, f"h{i}__{m}"
                rows = halves[h, i, m].score(rows, name).select(*kept, F.col(score_col(name)).alias(name))
        return rows

    pairs = [f"h{i}__{m}" for m in names for i in range(2)]
    apply_rows = None
    if calibrated_cv:
        apply_rows = _union([
            _tag(with_halves(h, train.where(outer_fold == h)), held_out=h) for h in range(n_outer)
        ]).select("row_id", "held_out", "y", *pairs)
        apply_rows = _tag(apply_rows, **tags)
    test_rows = with_halves(-1, score_all([final[m] for m in names], test))
    test_rows = test_rows.select("row_id", "y", *keep_test, *scored, *pairs)
    return ScopeScores(_tag(cv_rows, **tags), _tag(fit_rows, **tags), apply_rows, _tag(test_rows, **tags), final)


def vote_cv_scores(
    scope: Scope, outcome: str, train: DataFrame, plan: FoldPlan, algos: Sequence[Algorithm],
    settings: ModelSettings, n_features: int, pool: ThreadPoolExecutor, ready: Ready | None = None,
) -> DataFrame:
    """Held-out scores of ensemble members over the outer folds. A vote adds no fit of its own."""
    fold = plan.column("outer", scope, outcome)
    k = plan.sizes["outer"]
    jobs = {(f, a.name): _submit(pool, ready, Part(*scope.key, outcome, "outer", -1, f), fit, a, train.where(fold != f),
                                 plan.rest("outer", scope, outcome, f), n_features, settings) for f in range(k) for a in algos}
    fitted = {key: job.result() for key, job in jobs.items()}
    names = [a.name for a in algos]
    rows = _union([
        _tag(score_all([fitted[f, m] for m in names], train.where(fold == f)), fold=f) for f in range(k)
    ])
    cols = [c for m in names for c in (p_col(m), yhat_col(m))]
    return _tag(rows.select("row_id", "fold", "y", *cols),
                attribute=scope.attribute, grp=scope.grp, outcome=outcome)


def cached(df: DataFrame) -> DataFrame:
    """Keep vectors near the fits. A lost block is rebuilt from the stored table below it."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
