"""Rounding for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_1dp(col: Column | str) -> Column:
    """A share as percent with one decimal, rounded half-even on the exact binary value.

    ``round`` would round the shortest decimal text half-up (2.25 -> 2.3); the
    number formatter works on the exact value, as Python's ``round`` does (2.2).
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.call_function("format_number", c * 100, F.lit("0.0")).cast("double")


def whole_percent(col: Column | str) -> Column:
    """A share as whole percent, ties to even."""
    c = F.col(col) if isinstance(col, str) else col
    return F.bround(c * 100, 0)
