"""Registered queries on the star-schema tables, with SQL twins where SQL can say it."""

from cohortlens.catalog.base import REGISTERED, Query

__all__ = ["REGISTERED", "Query", "load_all"]


def load_all() -> dict[str, Query]:
    from cohortlens.catalog import prepared, scored, selected, trained  # noqa: F401

    return REGISTERED
