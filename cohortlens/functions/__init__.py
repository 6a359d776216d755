from cohortlens.functions.encode import fit_levels, one_hot_columns, slug
from cohortlens.functions.order import hash_share, order_key
from cohortlens.functions.rounding import percent_1dp, whole_percent
from cohortlens.functions.rules import KeywordRule, equals_flag, keyword_bucket, member_flag

__all__ = [
    "KeywordRule", "equals_flag", "fit_levels", "hash_share", "keyword_bucket", "member_flag",
    "one_hot_columns", "order_key", "percent_1dp", "slug", "whole_percent",
]
