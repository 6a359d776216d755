from cohortlens.sources.store import ResultStore
from cohortlens.sources.tables import drop_matching, read_cohort, read_split

__all__ = ["ResultStore", "drop_matching", "read_cohort", "read_split"]
