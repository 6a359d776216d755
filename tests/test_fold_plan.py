import random

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.order import order_key
from cohortlens.operators import training
from cohortlens.operators.subgroups import Registry, Subgroup
from cohortlens.operators.training import plan_folds, scopes_of

REGISTRY = Registry((Subgroup("g", "a", "g = 'a'"), Subgroup("g", "tiny", "g = 'b'"), Subgroup("h", "odd", "row_id % 2 = 1"), Subgroup("h", "nobody", "g = 'z'")))
SIZES = {"population": 3, "subgroup": 2, "outer": 5, "inner": 2}


def deal(rows, k):
    """Fold of each (key, label): sort by class of first appearance, deal in turn, then cut every class into blocks."""
    classes = sorted({y for _, y in rows}, key=lambda y: (min(key for key, z in rows if z == y), y))
    position, sizes = 0, {}
    for y in classes:
        members = sorted(key for key, z in rows if z == y)
        sizes[y] = [0] * k
        for _ in members:
            sizes[y][position % k] += 1
            position += 1
    out = {}
    for y in classes:
        members = iter(sorted(key for key, z in rows if z == y))
        out.update({(next(members), y): f for f in range(k) for _ in range(sizes[y][f])})
    return out


def made_up(spark, n, positives, seed):
    rng = random.Random(seed)
    rows = [(i, "b" if i < 6 else rng.choice("aac"), int(rng.random() < positives), int(i % 3 == 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, g string, y1 int, y2 int").repartition(3)
    return df.withColumn("okey", order_key("row_id", 13))


@pytest.mark.parametrize(("n", "positives", "few"), [(300, 0.3, 4096), (300, 0.02, 1), (23, 0.3, 4096), (9, 0.0, 4096), (400, 0.5, 2)])
def test_all_folds_equal_dealing_by_hand(spark, monkeypatch, n, positives, few):
    # so few rows under a prefix are told apart by numbering that the tree must be refined
    monkeypatch.setattr(training, "FEW_ROWS", few)
    monkeypatch.setattr(training, "PREFIX_DIGITS", 1 if few < 4096 else 3)
    train = made_up(spark, n, positives, n).cache()
    plan = plan_folds(train, REGISTRY, ["y1", "y2"], SIZES, 13)
    for scope in scopes_of(REGISTRY):
        members = scope.rows(train).collect()
        for outcome in ("y1", "y2"):
            rows = [(r["okey"], r[outcome]) for r in members]
            if not rows:
                assert not any(key[1:4] == (*scope.key, outcome) for key in plan.ends)
                continue
            outer = deal(rows, 5)
            want = {("cv", -1): deal(rows, plan.k("cv", scope)), ("outer", -1): outer, ("inner", -1): deal(rows, 2)}
            for h in range(5):
                part = [r for r in rows if outer[r] != h]
                if part:
                    want["inner", h] = deal(part, 2)
            for (name, h), folds in want.items():
                mine = plan.ends[(name, *scope.key, outcome, h)]
                got = {(key, y): sum(key > e for e in mine[y]) for key, y in folds}
                assert got == folds, (scope.key, outcome, name, h)
                for fold in range(max(folds.values()) + 1):
                    assert plan.count(name, scope, outcome, h, fold) == tuple(
                        sum(1 for (_, y), f in folds.items() if y == label and f == fold) for label in (0, 1))


def test_plan_columns_and_no_rows(spark):
    train = made_up(spark, 200, 0.4, 1)
    plan = plan_folds(train, REGISTRY, ["y1"], SIZES, 13, ("g",), nested=False)
    scope = scopes_of(REGISTRY, ("g",))[1]
    folds = scope.rows(train).withColumn("y", F.col("y1")).groupBy(plan.column("outer", scope, "y1").alias("f")).count().collect()
    assert {r["f"] for r in folds} == set(range(5)) and not any(key[4] >= 0 for key in plan.ends)
    assert not plan_folds(train.where("row_id < 0"), REGISTRY, ["y1"], SIZES, 13).ends
