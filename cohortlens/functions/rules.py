"""Rule columns: ordered keyword buckets and 0/1 indicators. All stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeywordRule:
    """Values that contain any of ``keywords`` belong to ``bucket``."""

    bucket: str
    keywords: tuple[str, ...]


def _text(col: Column | str, normalize: str | None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    if normalize is None:
        return c
    if normalize == "lower":
        return F.lower(c)
    if normalize == "trim_lower":
        return F.lower(F.trim(c))
    raise ValueError(f"unknown normalize option: {normalize!r}")


def keyword_bucket(
    col: Column | str, rules: Sequence[KeywordRule], default: str, normalize: str | None = "lower"
) -> Column:
    """First rule with a keyword inside the value wins; no match or null gives ``default``."""
    if not rules:
        raise ValueError("keyword_bucket needs at least one rule")
    text = _text(col, normalize)
    out: Column | None = None
    for rule in rules:
        hit = text.contains(rule.keywords[0])
        for word in rule.keywords[1:]:
            hit = hit | text.contains(word)
        out = F.when(hit, rule.bucket) if out is None else out.when(hit, rule.bucket)
    return out.otherwise(default)


def equals_flag(col: Column | str, value, normalize: str | None = None) -> Column:
    """1 where the value equals ``value``, else 0 (null gives 0)."""
    return F.when(_text(col, normalize) == F.lit(value), 1).otherwise(0)


def member_flag(col: Column | str, values: Sequence, normalize: str | None = None) -> Column:
    """1 where the value is one of ``values``, else 0 (null gives 0)."""
    return F.when(_text(col, normalize).isin(*values), 1).otherwise(0)
