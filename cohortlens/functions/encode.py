"""One-hot encoding with an explicit, fitted list of levels."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slug(text: str) -> str:
    """Column-name form of a level: lower case, runs of other characters become ``_``."""
    return re.sub(r"[^0-9a-z]+", "_", text.lower()).strip("_")


def _tokens(col: str, sep: str | None) -> Column:
    return F.split(F.col(col), re.escape(sep)) if sep else F.array(F.col(col))


def fit_levels(
    df: DataFrame, columns: Sequence[str], sep: str | None = None, max_levels: int | None = None
) -> dict[str, list[str]]:
    """Sorted levels per column, found in one pass.

    With ``sep`` a cell may hold several levels. Levels become table columns; a caller
    that wants no more than ``max_levels`` of them gets an error, never a silent cut.
    """
    def named(column: str) -> Column:
        pairs = F.transform(
            _tokens(column, sep), lambda v: F.struct(F.lit(column).alias("name"), v.alias("level"))
        )
        # a null cell makes split() null, and flatten() of a null entry is null
        return F.coalesce(pairs, F.expr("cast(array() as array<struct<name:string,level:string>>)"))

    if not columns:
        return {}
    pairs = F.flatten(F.array(*[named(c) for c in columns]))
    found = (
        df.select(F.explode(pairs).alias("e")).select("e.name", "e.level")
        .where("level is not null and level <> ''").distinct()
    )
    rows = found.collect() if max_levels is None else found.take(max_levels * len(columns) + 1)
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for row in rows:
        levels[row["name"]].append(row["level"])
    for name, values in levels.items():
        if max_levels is not None and len(values) > max_levels:
            raise ValueError(f"column {name} has more than {max_levels} levels")
        values.sort()
    return levels


def level_names(column: str, levels: Sequence[str]) -> dict[str, str]:
    """Column name of each level. Levels that differ only in signs get a number behind the name, in order."""
    names: dict[str, str] = {}
    taken: set[str] = set()
    for level in levels:
        base = f"{column}_{slug(level)}"
        name, turn = base, 1
        while name in taken:
            turn += 1
            name = f"{base}_{turn}"
        taken.add(name)
        names[level] = name
    return names


def one_hot_columns(
    levels: Mapping[str, Sequence[str]], reference: Mapping[str, str] | None = None, sep: str | None = None
) -> list[Column]:
    """One 0/1 column per kept level, named ``<column>_<level>``; null cells are 0 everywhere.

    ``reference`` names the level to drop per column and must be one of its levels.
    """
    reference = dict(reference or {})
    out: list[Column] = []
    for name, values in levels.items():
        dropped = reference.get(name)
        if dropped is not None and dropped not in values:
            raise ValueError(f"reference level {dropped!r} does not occur in column {name}")
        column_of = level_names(name, values)
        for level in values:
            if level == dropped:
                continue
            hit = F.array_contains(_tokens(name, sep), level) if sep else F.col(name) == level
            out.append(F.when(hit, 1).otherwise(0).alias(column_of[level]))
    return out
