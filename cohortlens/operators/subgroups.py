"""Subgroup registry and many-to-many membership.

A subgroup is a named condition under an attribute. Groups of one attribute may
overlap and need not cover every row. Membership is found in one pass over the
rows, from columns the row already carries, so it needs no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: label of the whole population
ALL = "all"


@dataclass(frozen=True)
class Subgroup:
    """``condition`` is a SQL expression over the columns of the cohort."""

    attribute: str
    name: str
    condition: str
    enabled: bool = True

    def column(self) -> Column:
        return F.expr(self.condition)


def any_of(*conditions: str) -> str:
    """Condition that holds if one of the given conditions holds."""
    return " or ".join(f"({c})" for c in conditions)


@dataclass(frozen=True)
class Registry:
    """Ordered subgroups. Disabled ones are kept but only used on request."""

    groups: tuple[Subgroup, ...]

    def __post_init__(self):
        seen = [(g.attribute, g.name) for g in self.groups]
        if len(seen) != len(set(seen)):
            raise ValueError("a subgroup is registered twice")

    def active(self, attributes: Iterable[str] | None = None, with_disabled: bool = False) -> list[Subgroup]:
        chosen = [g for g in self.groups if g.enabled or with_disabled]
        if attributes is not None:
            wanted = list(attributes)
            unknown = set(wanted) - {g.attribute for g in self.groups}
            if unknown:
                raise ValueError(f"unknown attribute(s): {sorted(unknown)}")
            chosen = [g for g in chosen if g.attribute in wanted]
        return chosen

    def attributes(self) -> list[str]:
        return list(dict.fromkeys(g.attribute for g in self.groups if g.enabled))

    def get(self, attribute: str, name: str) -> Subgroup:
        for g in self.groups:
            if (g.attribute, g.name) == (attribute, name):
                return g
        raise ValueError(f"no subgroup {attribute}/{name}")


def membership_column(groups: Iterable[Subgroup], whole: bool = False) -> Column:
    """Array of ``(attribute, grp)`` the row belongs to."""
    def entry(attribute: str, name: str) -> Column:
        return F.struct(F.lit(attribute).alias("attribute"), F.lit(name).alias("grp"))

    items = [entry(ALL, ALL)] if whole else []
    items += [F.when(g.column(), entry(g.attribute, g.name)) for g in groups]
    return F.array_compact(F.array(*items))


def member_pattern(groups: Iterable[Subgroup]) -> Column:
    """Text of one digit per group, 1 where the row belongs to it.

    There are far fewer patterns than rows, so sums can be formed per pattern first
    and spread over the groups afterwards.
    """
    return F.concat(*[F.when(g.column(), "1").otherwise("0") for g in groups])


def spread_pattern(df: DataFrame, groups: Iterable[Subgroup], pattern: str, whole: bool = True) -> DataFrame:
    """Replace the pattern column by one row per group it names, and one for everyone."""
    items = [F.struct(F.lit(ALL).alias("attribute"), F.lit(ALL).alias("grp"))] if whole else []
    items += [
        F.when(F.substring(pattern, i + 1, 1) == "1",
               F.struct(F.lit(g.attribute).alias("attribute"), F.lit(g.name).alias("grp")))
        for i, g in enumerate(groups)
    ]
    spread = df.withColumn("_member", F.explode(F.array_compact(F.array(*items))))
    return spread.select(*[c for c in df.columns if c != pattern], "_member.attribute", "_member.grp")


def with_membership(
    df: DataFrame, registry: Registry, whole: bool = False, attributes: Iterable[str] | None = None,
    with_disabled: bool = False,
) -> DataFrame:
    """One output row per row and group, with ``attribute`` and ``grp`` added."""
    groups = registry.active(attributes, with_disabled)
    return (
        df.withColumn("_member", F.explode(membership_column(groups, whole)))
        .select(*df.columns, F.col("_member.attribute").alias("attribute"), F.col("_member.grp").alias("grp"))
    )


def membership_table(df: DataFrame, registry: Registry, row_id: str = "row_id", **options) -> DataFrame:
    """Just ``(row_id, attribute, grp)``."""
    return with_membership(df, registry, **options).select(row_id, "attribute", "grp")


def subgroup_rows(df: DataFrame, group: Subgroup) -> DataFrame:
    """The rows of one group, columns unchanged. A plain filter, so it reaches the scan."""
    return df.where(group.column())
