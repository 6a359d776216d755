"""Readers, missing cells, column names, result partitions, and workers that have no copy of the package."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.encode import fit_levels, one_hot_columns
from cohortlens.operators.calibration import thresholds_up_to
from cohortlens.operators.features import fit_fill_values, impute
from cohortlens.operators.metrics import roc_auc
from cohortlens.operators.training import FoldPlan, Scope
from cohortlens.sources import ResultStore, read_cohort

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "stays.csv"
    path.write_text(',Unnamed: 0,age,sex,note\n0,7,61,F,"he said ""no"", then\nleft"\n1,8,NA,M,plain\n2,9,NaN,,N/A\n')
    rows = [tuple(r) for r in read_cohort(spark, str(path), "sex string, age double").collect()]
    assert rows == [("F", 61.0), ("M", None), (None, None)]
    free = read_cohort(spark, str(path))
    assert free.dtypes == [("age", "bigint"), ("sex", "string"), ("note", "string")]
    assert free.first()["note"] == 'he said "no", then\nleft'
    with pytest.raises(Exception):
        read_cohort(spark, str(path), "sex int").collect()


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (float("nan"),), (float("nan"),)], "x double")
    assert fit_fill_values(df, ["x"]).first()["x"] == 2.0
    assert fit_fill_values(df, ["x"], "mean").first()["x"] == 2.0
    assert sorted(r["x"] for r in impute(df, df, ["x"]).collect()) == [1.0, 2.0, 2.0, 2.0, 3.0]


def test_levels_that_differ_in_signs_keep_columns_of_their_own(spark):
    df = spark.createDataFrame([("80",), ("80+",), ("日",), ("本",)], "a string")
    out = df.select(*one_hot_columns(fit_levels(df, ["a"])))
    assert len(set(out.columns)) == 4 and out.columns[:2] == ["a_80", "a_80_2"]
    assert sorted(map(tuple, out.collect()), reverse=True) == [tuple(int(i == j) for j in range(4)) for i in range(4)]


def test_a_second_run_does_not_return_the_first_ones_groups(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    scores = lambda attribute: spark.createDataFrame([("y1", attribute, "g", 0.5)], "outcome string, attribute string, grp string, f1 double")
    store.write("cv_scores", scores("race"))
    assert [r["attribute"] for r in store.write("cv_scores", scores("sex")).collect()] == ["sex"]
    assert {r["attribute"] for r in store.read("cv_scores").collect()} == {"race", "sex"}


def test_an_emptied_training_part_has_a_fold_column(spark):
    fold = FoldPlan({"outer": 2}).column("inner", Scope("k", "r0"), "y1", held_out=0)
    assert spark.range(1).select(fold.alias("f")).first()["f"] == 0


def test_bisection_reaches_the_end_of_long_arrays(spark):
    n = (1 << 24) + 5
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).cast("array<double>").alias("xs"))
    assert df.select(thresholds_up_to(F.col("xs"), F.lit(float(n + 1)))).first()[0] == n


def test_auc_of_a_key_whose_scores_are_close_together(spark):
    rows = [("wide", i / 1000, i % 2) for i in range(1000)] + [("narrow", 0.5 + i * 1e-9, int(i % 3 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, p double, y int")
    for r in roc_auc(df, ["k"]).collect():
        own = [(p, y) for k, p, y in rows if k == r["k"]]
        pos, neg = [p for p, y in own if y], [p for p, y in own if not y]
        assert r["roc_auc"] == pytest.approx(sum(a > b for a in pos for b in neg) / (len(pos) * len(neg)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_workers_need_no_copy_of_the_package(tmp_path):
    """Run from another folder, with nothing on the workers' path."""
    code = (f"import sys; sys.path.insert(0, {REPO!r}); import __spark_entry__ as e; from cohortlens.session import local_session; "
            f"s = local_session('away', 4, 4); print('ROWS', e.queries()['q_isotonic'](s, {SF!r}).count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
