import pytest
from pyspark.sql import functions as F

from cohortlens.functions import (
    KeywordRule, equals_flag, fit_levels, keyword_bucket, member_flag, one_hot_columns, order_key, percent_1dp,
    whole_percent,
)
from cohortlens.plans.cohorts import ETHNICITY_DEFAULT, ETHNICITY_RULES


def test_keyword_buckets_take_the_first_rule(spark):
    cases = [
        ("WHITE - RUSSIAN", "white/caucasian-american"),
        ("black/african american", "black/african-american"),
        ("asian - indian", "asian/asian-american"),
        ("white hispanic", "white/caucasian-american"),  # two keywords: the earlier rule wins
        ("South American Indian", "alaska-native/american-indian"),
        ("native hawaiian", "polynesian/pacific-islander"),
        ("declined", ETHNICITY_DEFAULT),
        (None, ETHNICITY_DEFAULT),
    ]
    df = spark.createDataFrame(cases, "v string, want string")
    rows = df.select(keyword_bucket("v", ETHNICITY_RULES, ETHNICITY_DEFAULT).alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_flags_treat_null_and_case(spark):
    df = spark.createDataFrame([("home",), ("HOME",), ("dead",), (None,), ("hospice",)], "v string")
    rows = df.select(
        equals_flag("v", "dead").alias("e"), member_flag("v", ["home", "hospice"]).alias("m"),
        member_flag("v", ["home", "hospice"], normalize="lower").alias("l")).collect()
    assert [r["e"] for r in rows] == [0, 0, 1, 0, 0]
    assert [r["m"] for r in rows] == [1, 0, 0, 0, 1]
    assert [r["l"] for r in rows] == [1, 1, 0, 0, 1]
    with pytest.raises(ValueError):
        keyword_bucket("v", [KeywordRule("a", ("a",))], "b", normalize="upper")


def test_one_hot_levels_reference_and_multi_valued_cells(spark):
    df = spark.createDataFrame([("a|b", "m"), ("b", "f"), (None, "m"), ("c", None)], "tags string, sex string")
    assert fit_levels(df, ["sex"]) == {"sex": ["f", "m"]}
    levels = fit_levels(df, ["tags"], sep="|")
    assert levels == {"tags": ["a", "b", "c"]}
    rows = df.select(*one_hot_columns(levels, {"tags": "c"}, sep="|")).collect()
    assert [tuple(r) for r in rows] == [(1, 1), (0, 1), (0, 0), (0, 0)]
    # a level not seen when fitting sets no indicator
    new = spark.createDataFrame([("z",), ("f",)], "sex string")
    assert [r[0] for r in new.select(*one_hot_columns({"sex": ["f", "m"]}, {"sex": "m"})).collect()] == [0, 1]
    with pytest.raises(ValueError):
        one_hot_columns({"sex": ["f", "m"]}, {"sex": "x"})
    with pytest.raises(ValueError):
        fit_levels(df, ["tags"], max_levels=2)


def test_percent_rounding_matches_python(spark):
    values = [0.0225, 0.0475, 0.12345, 0.98765, 1.0, 0.0, 0.33333, 0.5725, 0.15, 0.005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(percent_1dp("v")).collect()] == [round(v * 100, 1) for v in values]
    assert [r[0] for r in df.select(whole_percent(F.lit(0.125))).limit(1).collect()] == [12.0]


def test_order_key_is_a_seeded_permutation(spark):
    df = spark.range(1000)
    keys = [r[0] for r in df.select(order_key("id", 13)).collect()]
    assert len(set(keys)) == 1000
    assert keys != sorted(keys)
    assert keys == [r[0] for r in df.repartition(7).orderBy("id").select(order_key("id", 13)).collect()]
    assert keys != [r[0] for r in df.select(order_key("id", 14)).collect()]
