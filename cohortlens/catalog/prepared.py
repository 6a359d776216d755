"""Queries on cohort preparation: rules, encoding, splits, imputation, membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.catalog import sql as S
from cohortlens.catalog.base import query
from cohortlens.functions import KeywordRule, equals_flag, fit_levels, keyword_bucket, member_flag, one_hot_columns
from cohortlens.operators.cohort import derive, feature_table, fit_cohort_levels
from cohortlens.operators.features import impute, outside_range, standardize
from cohortlens.operators.orderstats import group_medians
from cohortlens.operators.split import inner_folds, split_train_test, stratified_folds
from cohortlens.operators.subgroups import membership_table, with_membership
from cohortlens.plans import cohorts as C
from cohortlens.sources import ResultStore, drop_matching, read_cohort, read_split
from cohortlens.session import new_folder

PART_RULES = (
    KeywordRule("fastener", ("bolt", "screw", "nut")),
    KeywordRule("warm", ("red", "orange")),
    KeywordRule("cold", ("blue", "green")),
    KeywordRule("round", ("ring", "gear")),
)


@query("q_bucket_rules", """
SELECT p_partkey, CASE
  WHEN contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'screw') OR contains(lower(p_name), 'nut') THEN 'fastener'
  WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'orange') THEN 'warm'
  WHEN contains(lower(p_name), 'blue') OR contains(lower(p_name), 'green') THEN 'cold'
  WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'gear') THEN 'round'
  ELSE 'other' END AS bucket
FROM part""")
def bucket_rules(spark, folder):
    parts = read_cohort(spark, f"{folder}/part.parquet")
    return parts.select("p_partkey", keyword_bucket("p_name", PART_RULES, "other").alias("bucket"))


TEXT_RULES = (
    KeywordRule("legal", ("license", "copyright")),
    KeywordRule("secret", ("password", "api_key", "token")),
    KeywordRule("contact", ("@",)),
    KeywordRule("link", ("http://", "https://")),
)


@query("q_bucket_documents", """
SELECT lang, bucket, count(*) AS n FROM (
  SELECT lang, CASE
    WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'legal'
    WHEN contains(lower(text), 'password') OR contains(lower(text), 'api_key') OR contains(lower(text), 'token') THEN 'secret'
    WHEN contains(lower(text), '@') THEN 'contact'
    WHEN contains(lower(text), 'http://') OR contains(lower(text), 'https://') THEN 'link'
    ELSE 'plain' END AS bucket FROM documents) GROUP BY ALL""")
def bucket_documents(spark, folder):
    docs = read_cohort(spark, f"{folder}/documents.parquet")
    named = docs.select("lang", keyword_bucket("text", TEXT_RULES, "plain").alias("bucket"))
    return named.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("q_outcomes", """
SELECT o_orderkey, CASE WHEN lower(o_orderstatus) = 'p' THEN 1 ELSE 0 END AS is_pending,
       CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END AS is_started FROM orders""")
def outcomes(spark, folder):
    orders = read_cohort(spark, f"{folder}/orders.parquet")
    return orders.select(
        "o_orderkey", equals_flag("o_orderstatus", "p", normalize="lower").alias("is_pending"),
        member_flag("o_orderstatus", ("F", "P")).alias("is_started"))


def _one_hot_sql() -> str:
    levels = [
        ("segment", ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]),
        ("region", ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]),
        ("priority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]),
        ("band", ["to_100k", "to_200k", "to_300k", "to_400k", "top"]),
    ]
    return ", ".join(
        f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS {c}_{v.lower().replace(' ', '_').replace('-', '_')}"
        for c, vs in levels for v in vs)


@query("q_onehot", f"WITH {S.ORDERS} SELECT row_id, {_one_hot_sql()} FROM cohort")
def onehot(spark, folder):
    df = C.orders_cohort(spark, folder)
    levels = fit_cohort_levels(df, C.ORDER_SPEC)
    return df.select("row_id", *one_hot_columns(levels, C.ORDER_SPEC.categorical))


@query("q_onehot_multi", f"""
WITH {S.ORDERS} SELECT row_id,
  CASE WHEN list_contains(string_split(flags, '|'), 'A') THEN 1 ELSE 0 END AS flags_a,
  CASE WHEN list_contains(string_split(flags, '|'), 'R') THEN 1 ELSE 0 END AS flags_r FROM cohort""")
def onehot_multi(spark, folder):
    df = C.orders_cohort(spark, folder)
    levels = fit_levels(df, ["flags"], sep="|")
    return df.select("row_id", *one_hot_columns(levels, {"flags": "N"}, sep="|"))


@query("q_feature_table", f"""
WITH {S.ORDERS} SELECT row_id, n_lines, qty, disc, price, acctbal, {_one_hot_sql()}, y1, y2,
  segment, region, priority, band FROM cohort""")
def feature_rows(spark, folder):
    df = derive(drop_matching(C.orders_cohort(spark, folder)), C.ORDER_SPEC)
    return feature_table(df, C.ORDER_SPEC, fit_cohort_levels(df, C.ORDER_SPEC))[0]


@query("q_document_features", """
SELECT d.doc_id AS row_id, CAST(length(text) AS DOUBLE) AS n_chars,
  CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE) AS n_words,
  CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE) AS n_lines,
  CAST(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS DOUBLE) AS n_digits,
  CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS lang_de, CASE WHEN lang = 'es' THEN 1 ELSE 0 END AS lang_es,
  CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS lang_fr, toxic AS y1, quality AS y2, lang, source,
  CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 2500 THEN 'mid' ELSE 'long' END AS length_band
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def document_features(spark, folder):
    df = derive(C.documents_cohort(spark, folder), C.DOCUMENT_SPEC)
    return feature_table(df, C.DOCUMENT_SPEC, fit_cohort_levels(df, C.DOCUMENT_SPEC))[0]


def _labelled(spark, folder):
    return derive(C.orders_cohort(spark, folder), C.ORDER_SPEC)


@query("q_split", f"WITH {S.SPLIT} SELECT row_id, is_test FROM split")
def split(spark, folder):
    return split_train_test(_labelled(spark, folder).select("row_id"))


@query("q_split_store", f"""
WITH {S.SPLIT} SELECT is_test, count(*) AS n, sum(y1)::BIGINT AS y1_n, sum(y2)::BIGINT AS y2_n FROM split GROUP BY is_test""")
def split_store(spark, folder):
    """Write the split as a partitioned table and re-read its two parts."""
    store = ResultStore(spark, new_folder(spark, "split"))
    saved = store.write("split", split_train_test(_labelled(spark, folder)))
    parts = [read_split(saved, p).withColumn("is_test", F.lit(p == "test")) for p in ("train", "test")]
    return parts[0].unionByName(parts[1]).groupBy("is_test").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y1").alias("y1_n"), F.sum("y2").alias("y2_n"))


_TRAIN = f"{S.SPLIT}, train AS (SELECT row_id, okey, y1, y2 FROM split WHERE NOT is_test)"


@query("q_stratified_folds", f"WITH {_TRAIN}, {S.folds('train', 'f', 3, '', 'y1')} SELECT row_id, y1, fold FROM f")
def folds(spark, folder):
    train = read_split(split_train_test(_labelled(spark, folder)), "train").select("row_id", "y1")
    return stratified_folds(train, "y1", 3)


@query("q_scope_folds", f"""
WITH {S.SPLIT}, train AS (SELECT * FROM split WHERE NOT is_test), {S.member('train', whole=False)},
{S.folds('member', 'f', 2, 'attribute, grp', 'y1')} SELECT row_id, attribute, grp, y1, fold FROM f""")
def scope_folds(spark, folder):
    train = read_split(split_train_test(_labelled(spark, folder)), "train")
    rows = with_membership(train, C.ORDER_REGISTRY).select("row_id", "attribute", "grp", "y1")
    return stratified_folds(rows, "y1", 2, ["attribute", "grp"])


@query("q_inner_folds", f"""
WITH {_TRAIN}, {S.folds('train', 'f', 5, '', 'y1')},
parts AS (SELECT row_id, okey, y1, fold AS outer_fold, CAST(h AS INTEGER) AS held_out FROM f, range(5) t(h) WHERE h <> fold),
{S.folds('parts', 'g', 2, 'held_out', 'y1')}
SELECT row_id, y1, outer_fold, held_out, fold AS "inner" FROM g""")
def nested_folds(spark, folder):
    train = read_split(split_train_test(_labelled(spark, folder)), "train").select("row_id", "y1")
    outer = stratified_folds(train, "y1", 5, fold="outer_fold")
    return inner_folds(outer, "y1", outer="outer_fold", n_outer=5)


_NUM = list(C.ORDER_SPEC.numeric)


def _fill_sql(fn: str) -> str:
    cols = ", ".join(f"round(coalesce({c}, (SELECT {fn}({c}) FROM split WHERE NOT is_test)), 6) AS {c}" for c in _NUM)
    return f"WITH {S.SPLIT} SELECT row_id, is_test, {cols} FROM split"


def _imputed(spark, folder, strategy):
    df = split_train_test(_labelled(spark, folder)).select("row_id", "is_test", *_NUM)
    return impute(read_split(df, "train"), df, _NUM, strategy)


def _rounded(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("q_median_impute", _fill_sql("median"))
def median_impute(spark, folder):
    return _rounded(_imputed(spark, folder, "median"), _NUM)


@query("q_mean_impute", _fill_sql("avg"))
def mean_impute(spark, folder):
    return _rounded(_imputed(spark, folder, "mean"), _NUM)


@query("q_scope_medians", f"""
WITH {S.SPLIT}, train AS (SELECT * FROM split WHERE NOT is_test), {S.member('train')}
SELECT attribute, grp, {', '.join(f'round(median({c}), 6) AS {c}' for c in _NUM)} FROM member GROUP BY attribute, grp""")
def scope_medians(spark, folder):
    train = read_split(split_train_test(_labelled(spark, folder)), "train")
    return _rounded(group_medians(train, _NUM, C.ORDER_REGISTRY), _NUM)


@query("q_standardize", f"""
WITH {S.SPLIT}, filled AS (SELECT row_id, is_test, {', '.join(
    f'coalesce({c}, (SELECT median({c}) FROM split WHERE NOT is_test)) AS {c}' for c in _NUM)} FROM split),
fit AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _NUM)} FROM filled WHERE NOT is_test)
SELECT row_id, is_test, {', '.join(f'round(({c} - m_{c}) / s_{c}, 6) AS {c}' for c in _NUM)} FROM filled, fit""")
def standardized(spark, folder):
    df = _imputed(spark, folder, "median")
    return _rounded(standardize(read_split(df, "train"), df, _NUM), _NUM)


@query("q_range_check", f"WITH {S.ORDERS} SELECT row_id, acctbal FROM cohort WHERE acctbal < 0")
def range_check(spark, folder):
    return outside_range(C.orders_cohort(spark, folder), "acctbal", low=0).select("row_id", "acctbal")


@query("q_membership", f"WITH {S.ORDERS}, {S.member('cohort', whole=False)} SELECT row_id, attribute, grp FROM member")
def memberships(spark, folder):
    return membership_table(C.orders_cohort(spark, folder), C.ORDER_REGISTRY)


@query("q_union_groups", f"""
WITH {S.ORDERS}, {S.member('cohort', whole=False, groups=S.GROUPS + S.EXTRA_GROUPS)}
SELECT attribute, grp, count(*) AS n, sum(y1)::BIGINT AS y1_n FROM member GROUP BY attribute, grp""")
def union_groups(spark, folder):
    rows = with_membership(_labelled(spark, folder), C.ORDER_REGISTRY, with_disabled=True)
    return rows.groupBy("attribute", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("y1").alias("y1_n"))


@query("q_csv_cohort", """
SELECT 'said "' || o_orderpriority || '",' || chr(10) || 'then ' || o_orderstatus AS note, count(*) AS n,
       CAST(sum(o_orderkey) AS BIGINT) AS ids, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM orders GROUP BY ALL""")
def csv_cohort(spark, folder):
    """All orders written as CSV, with quotes and line breaks inside cells, and read again in splits."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.col("o_orderkey").alias("row_id"),
        F.concat(F.lit('said "'), "o_orderpriority", F.lit('",\nthen '), "o_orderstatus").alias("note"), F.col("o_totalprice").alias("price"))
    path = new_folder(spark, "orders-csv")
    orders.write.options(header=True, escape='"').csv(path)
    back = read_cohort(spark, path, "price double, note string, row_id bigint", "csv")
    return back.groupBy("note").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"),
                                    F.sum(F.round(F.col("price") * 100).cast("long")).alias("cents"))
