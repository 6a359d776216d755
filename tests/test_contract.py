import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import canonical

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
CHEAP = ["q_bucket_rules", "q_feature_table", "q_split", "q_median_impute", "q_subgroup_metrics", "q_auc", "q_isotonic",
         "q_hard_vote", "q_evaluation"]


def test_names():
    assert set(oracle_sql()) <= set(queries())
    assert all(name.startswith(("q_", "m_", "op")) or name == "pipeline" for name in queries())
    assert all(name in oracle_sql() for name in queries() if name.startswith("q_"))


@needs_data
def test_entry(spark):
    df = entry(spark)
    assert df.count() == 72 and "f1" in df.columns


@needs_data
@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries()[name](spark, FOLDER)
    rel = con.execute(oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), columns)


@needs_data
def test_plans_stay_in_the_engine(spark):
    plan = lambda name: queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    metrics = plan("q_subgroup_metrics")
    assert "Python" not in metrics and "Window" not in metrics and "Cartesian" not in metrics
    # only the columns that are used are read
    assert "l_extendedprice" not in metrics and "o_orderdate" not in metrics
    auc = plan("q_auc")
    assert "Python" not in auc
    # windows run inside a slice of the score axis, or over slices; never over all rows of a group
    assert all("_slice" in line for line in auc.splitlines() if "+- Window " in line)
