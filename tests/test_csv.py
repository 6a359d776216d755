"""Records of CSV files that are cut anywhere."""

import csv
import random

import pytest

from cohortlens.sources import read_cohort
from cohortlens.sources.csv import csv_records


@pytest.mark.parametrize("size,end", [("16", "\n"), ("97", "\r\n"), ("1m", "\n")])
def test_splits_of_any_size_give_the_same_rows(spark, tmp_path, size, end):
    rng = random.Random(3)
    rows = [(str(i), "".join(rng.choice('ab",\n ') for _ in range(rng.randrange(0, 60))) + "z", "é" * rng.randrange(1, 4)) for i in range(120)]
    for k in (0, 1):
        with open(tmp_path / f"{k}.csv", "w", newline="") as f:
            f.write(end)  # an empty line is no record, not even the first
            csv.writer(f, lineterminator=end).writerows([("id", 'no"te', "tail"), *rows[k::2]])
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = read_cohort(spark, str(tmp_path), fmt="csv")
        assert df.columns == ["id", 'no"te', "tail"]
        assert sorted((r[0], r[1], r[2]) for r in df.collect()) == sorted((int(a), b, c) for a, b, c in rows)
        if size == "16":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 100
        assert csv_records(spark, str(tmp_path)).where("first").count() == 2
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
