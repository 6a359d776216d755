"""One partitioned table per stage instead of a tree of small files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import materialize

#: stage name -> partition columns
STAGES: dict[str, tuple[str, ...]] = {
    "split": ("is_test",),
    "cv_scores": ("outcome", "attribute", "grp"),
    "predictions": ("outcome", "attribute", "grp"),
    "ensemble_cv": ("outcome", "attribute", "grp"),
    "ensemble_predictions": ("outcome", "attribute", "grp"),
    "evaluation": ("outcome",),
    "reports": ("report",),
}

#: attribute and group of the whole-population scope (partition columns must not be null)
ALL = "all"


@dataclass(frozen=True)
class ResultStore:
    """Stage tables below one root folder."""

    spark: SparkSession
    root: str

    def path(self, stage: str) -> str:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}; expected one of {sorted(STAGES)}")
        return f"{self.root.rstrip('/')}/{stage}"

    def write(self, stage: str, df: DataFrame, mode: str = "overwrite") -> DataFrame:
        """Write a stage and return it as read back.

        Overwriting is per partition, so writing one subgroup keeps the others. What
        comes back are the partitions just written, not those of earlier runs.
        """
        keys = [c for c in STAGES[stage] if c in df.columns]
        for key in ("attribute", "grp"):
            if key in keys:
                df = df.withColumn(key, F.coalesce(F.col(key), F.lit(ALL)))
        df = materialize(df, f"stage-{stage}")
        (df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(self.path(stage)))
        if not keys:
            return self.read(stage)
        # a few folders: as literals they prune partitions
        name = F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys])
        written = [r["name"] for r in df.select(name.alias("name")).distinct().collect()]
        return self.read(stage).where(name.isin(written) if written else F.lit(False))

    def read(self, stage: str, **where: str) -> DataFrame:
        """Read a stage; ``where`` on partition columns prunes folders, not rows."""
        try:
            found = self.spark.read.parquet(self.path(stage)).schema
        except AnalysisException as err:
            raise FileNotFoundError(f"stage {stage!r} has not been written below {self.root}") from err
        # folder names carry no types: state them, so that a group called "007" stays text
        typed = T.StructType([
            T.StructField(f.name, T.BooleanType() if f.name == "is_test" else T.StringType())
            if f.name in STAGES[stage] else f for f in found.fields
        ])
        df = self.spark.read.schema(typed).parquet(self.path(stage))
        for name, value in where.items():
            df = df.where(F.col(name) == F.lit(value))
        return df
