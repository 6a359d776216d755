import collections
import glob
import os
import re

import pytest

import corpus_pipeline
from __spark_entry__ import queries
from cohortlens.llm.catalog import QUERIES
from cohortlens.session import materialize

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_registered():
    assert set(QUERIES) <= set(queries())
    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES if n != "pipeline"} == {str(i) for i in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "private", "mixture", "packing"]


def test_nothing_else_uses_this_package():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for path in glob.glob(f"{root}/cohortlens/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "llm" not in open(path).read(), path


@needs_data
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "stage")
        results[name] = docs.collect()
    ids = {n: {r["doc_id"] for r in rows} for n, rows in results.items()}
    good = {i for i, r in labels.items() if r["quality"] == 1 and i in before}
    assert len(good & ids["quality"]) > 0.9 * len(good) and len(ids["quality"]) < len(before)
    assert ids["near_duplicates"] <= ids["quality"] and ids["private"] == ids["near_duplicates"]
    assert len({before[i]["text"] for i in ids["near_duplicates"]}) == len(ids["near_duplicates"])
    assert not any(re.search(r"[\w.]+@\w+\.\w+", r["text"]) for r in results["private"])
    times = collections.Counter(r["doc_id"] for r in results["mixture"])
    assert max(times.values()) <= 3
    size = {r["doc_id"]: len(r["text"].encode().split()) for r in results["private"]}
    packed = collections.Counter()
    for r in results["packing"]:
        assert len(r["text"].encode().split()) == r["n_words"]
        packed[r["doc_id"]] += r["n_words"]
    assert packed == {i: size[i] * n for i, n in times.items()}
    assert max(collections.Counter((r["bin_id"], r["doc_id"]) for r in results["packing"]).values()) == 1
