"""Cohorts: the hospital-stay layout, and two cohorts on the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.rules import KeywordRule
from cohortlens.operators.cohort import Bucketed, CohortSpec, Outcome
from cohortlens.operators.subgroups import Registry, Subgroup, any_of

# --- hospital stays: fixed values -----------------------------------------
# Keyword order, level names, outcome values and group rules decide the results,
# so they are stated here as they are.

ETHNICITY_RULES = (
    KeywordRule("white/caucasian-american", ("white", "portuguese")),
    KeywordRule("black/african-american", ("black", "african")),
    KeywordRule("asian/asian-american", ("asian",)),
    KeywordRule("latinx/hispanic-american", ("hispanic", "latino")),
    KeywordRule("alaska-native/american-indian", ("american indian", "alaska native", "alaska")),
    KeywordRule("polynesian/pacific-islander", ("hawaiian", "pacific islander")),
)
ETHNICITY_DEFAULT = "unknown/unspecified"

STAY_NUMERIC = (
    "age", "los-h(days)", "n-stemi?", "shock?", "c-shock?", "received-analgesic?", "received-opioid?",
    "received-non-opioid?", "received-opioids-only?", "received-non-opioids-only?", "received-combined-therapy?",
    "received-ace-inhibitor?", "received-aspirin?", "received-beta-blocker?", "received-anti-platelet?",
    "received-statin?",
)

STAY_SPEC = CohortSpec(
    row_id="row_id",
    numeric=STAY_NUMERIC,
    categorical={"agegroup": "18-39", "gender": "m", "insurance": "self pay", "race": "unknown/unspecified"},
    buckets={"race": Bucketed("ethnicity", ETHNICITY_RULES, ETHNICITY_DEFAULT)},
    outcomes={
        "y1": Outcome("discharge_location", ("dead/expired",)),
        "y2": Outcome("discharge_location", ("home", "home health care", "home with home iv providr")),
    },
    carry=("agegroup", "gender", "insurance", "race"),
)

STAY_REGISTRY = Registry((
    Subgroup("sex", "male", "coalesce(gender, '') <> 'f'"),
    Subgroup("sex", "female", "gender = 'f'"),
    Subgroup("race", "white", "race = 'white/caucasian-american'"),
    Subgroup("race", "non-white", any_of(
        "race = 'latinx/hispanic-american'", "race = 'black/african-american'",
        "race = 'asian/asian-american'", "race = 'alaska-native/american-indian'")),
    Subgroup("insurance", "private", "insurance = 'private'"),
    Subgroup("insurance", "government", any_of(
        "insurance = 'medicaid'", "insurance = 'medicare'", "insurance = 'government'")),
    Subgroup("age-group", "forties", "agegroup = '40-49'"),
    Subgroup("age-group", "fifties", "agegroup = '50-59'"),
    Subgroup("age-group", "sixties", "agegroup = '60-69'"),
    Subgroup("age-group", "seventies", "agegroup = '70-79'"),
    Subgroup("age-group", "eighty-and-over", "agegroup = '80+'"),
    Subgroup("race", "black", "race = 'black/african-american'", enabled=False),
    Subgroup("race", "black-latino-native", any_of(
        "race = 'latinx/hispanic-american'", "race = 'black/african-american'",
        "race = 'alaska-native/american-indian'"), enabled=False),
    Subgroup("race", "unknown", f"race = '{ETHNICITY_DEFAULT}'", enabled=False),
))

# --- orders ---------------------------------------------------------------

ORDER_ATTRIBUTES = ("segment", "region", "priority", "band")

ORDER_SPEC = CohortSpec(
    row_id="row_id",
    numeric=("n_lines", "qty", "disc", "price", "acctbal"),
    categorical={"segment": "AUTOMOBILE", "region": "AFRICA", "priority": "4-NOT SPECIFIED", "band": "entry"},
    outcomes={"y1": Outcome("hit", (1,)), "y2": Outcome("status", ("F", "P"))},
    carry=ORDER_ATTRIBUTES,
)

ORDER_REGISTRY = Registry((
    Subgroup("segment", "building", "segment = 'BUILDING'"),
    Subgroup("segment", "home", any_of("segment = 'FURNITURE'", "segment = 'HOUSEHOLD'")),
    Subgroup("region", "asia", "region = 'ASIA'"),
    Subgroup("region", "non_asia", any_of(
        "region = 'AFRICA'", "region = 'AMERICA'", "region = 'EUROPE'", "region = 'MIDDLE EAST'")),
    Subgroup("priority", "urgent", "priority = '1-URGENT'"),
    Subgroup("priority", "ranked", any_of(
        "priority = '2-HIGH'", "priority = '3-MEDIUM'", "priority = '5-LOW'")),
    Subgroup("band", "to_100k", "band = 'to_100k'"),
    Subgroup("band", "to_200k", "band = 'to_200k'"),
    Subgroup("band", "to_300k", "band = 'to_300k'"),
    Subgroup("band", "to_400k", "band = 'to_400k'"),
    Subgroup("band", "top", "band = 'top'"),
    Subgroup("region", "west", any_of("region = 'AMERICA'", "region = 'EUROPE'"), enabled=False),
    Subgroup("segment", "other", "segment not in ('BUILDING', 'FURNITURE', 'HOUSEHOLD')", enabled=False),
))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders_cohort(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order, with nulls where an order has no lines.

    Lines are combined per order before the join. Sums run over whole numbers, so
    the result does not depend on the order of summation.
    """
    lines = _table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines_i"),
        F.sum(F.col("l_quantity").cast("long")).alias("qty_i"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("disc_pts"),
        F.max(F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09), 1).otherwise(0)).alias("hit"),
        F.array_join(F.sort_array(F.collect_set("l_returnflag")), "|").alias("flags"),
    )
    customers = (
        _table(spark, folder, "customer")
        .join(_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("acctbal"),
                F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"))
    )
    price = F.col("o_totalprice")
    band = (
        F.when(price < 20_000, "entry").when(price < 100_000, "to_100k").when(price < 200_000, "to_200k")
        .when(price < 300_000, "to_300k").when(price < 400_000, "to_400k").otherwise("top")
    )
    return (
        _table(spark, folder, "orders").join(customers, "o_custkey").join(lines, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").alias("row_id"),
            F.col("n_lines_i").cast("double").alias("n_lines"),
            F.col("qty_i").cast("double").alias("qty"),
            (F.col("disc_pts").cast("double") / (F.col("n_lines_i") * 100).cast("double")).alias("disc"),
            price.alias("price"), "acctbal", "segment", "region",
            F.col("o_orderpriority").alias("priority"), band.alias("band"), "flags",
            F.col("hit"), F.col("o_orderstatus").alias("status"),
            "n_lines_i", "qty_i", "disc_pts",
        )
    )


SCORERS = ("a", "b", "c")


def scored_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with labels and three closed-form scores, so that every later result can be checked in SQL."""
    from cohortlens.operators.cohort import derive
    from cohortlens.operators.votes import with_classes

    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    df = derive(orders_cohort(spark, folder), ORDER_SPEC)
    df = df.withColumns({
        "p__a": F.least(zero("disc_pts") / 80.0, F.lit(1.0)),
        "p__b": F.least(zero("qty_i") / 400.0, F.lit(1.0)),
        "p__c": F.least(zero("n_lines_i") * 0.05 + zero("disc_pts") * 0.005, F.lit(1.0)),
    })
    cols = ["row_id", *ORDER_ATTRIBUTES, "y1", "y2", *[f"p__{m}" for m in SCORERS]]
    return with_classes(df.select(*cols), SCORERS)


# --- documents ------------------------------------------------------------

DOCUMENT_ATTRIBUTES = ("lang", "source", "length_band")
DOCUMENT_NUMERIC = ("n_chars", "n_words", "n_lines", "n_digits")

DOCUMENT_SPEC = CohortSpec(
    row_id="row_id",
    numeric=DOCUMENT_NUMERIC,
    categorical={"lang": "en"},
    outcomes={"y1": Outcome("toxic", (1,)), "y2": Outcome("quality", (1,))},
    carry=("lang", "source", "length_band"),
)

DOCUMENT_REGISTRY = Registry((
    Subgroup("lang", "english", "lang = 'en'"),
    Subgroup("lang", "non_english", any_of("lang = 'de'", "lang = 'es'", "lang = 'fr'")),
    Subgroup("source", "src0", "source = 'src0'"),
    Subgroup("source", "src1_or_src2", any_of("source = 'src1'", "source = 'src2'")),
    Subgroup("length", "short", "length_band = 'short'"),
    Subgroup("length", "long", "length_band = 'long'"),
))


def documents_cohort(spark: SparkSession, folder: str) -> DataFrame:
    """One row per labelled document, features counted over the whole text."""
    docs = _table(spark, folder, "documents").join(_table(spark, folder, "labels"), "doc_id")

    def occurrences(chars: str) -> Column:
        return F.length("text") - F.length(F.translate("text", chars, ""))

    n_chars = F.length("text")
    return docs.select(
        F.col("doc_id").alias("row_id"),
        n_chars.cast("double").alias("n_chars"),
        (occurrences(" ") + 1).cast("double").alias("n_words"),
        (occurrences("\n") + 1).cast("double").alias("n_lines"),
        occurrences("0123456789").cast("double").alias("n_digits"),
        "lang", "source",
        F.when(n_chars < 500, "short").when(n_chars < 2500, "mid").otherwise("long").alias("length_band"),
        "toxic", "quality",
    )
