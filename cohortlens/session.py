"""Session settings and the folder for tables shared between stages."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_LOCAL_FOLDERS: dict[str, str] = {}
#: tables written inside each open block of temporary ones, and those of them that stay
_TEMPORARY: list[list[str]] = []
_KEPT: set[str] = set()


def local_session(app: str = "cohortlens", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster, use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` as the cluster sets it.

    Only a local master may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="cohortlens-")
    return _LOCAL_FOLDERS[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a checkpoint does, but as parquet: later stages still
    prune columns and partitions, and a lost executor costs a re-read only.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    if _TEMPORARY:
        _TEMPORARY[-1].append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; results that go on must be written after it, or be named by ``kept``."""
    _TEMPORARY.append([])
    try:
        yield
    finally:
        for path in _TEMPORARY.pop():
            if path in _KEPT:
                # an outer block has the next say
                if _TEMPORARY:
                    _TEMPORARY[-1].append(path)
            else:
                place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            _KEPT.discard(path)


def kept(df: DataFrame, label: str) -> DataFrame:
    """:func:`materialize`, outliving the :func:`temporary_tables` around it."""
    out = materialize(df, label)
    if _TEMPORARY:
        _KEPT.add(_TEMPORARY[-1][-1])
    return out


def settled(df: DataFrame, label: str = "fitted") -> DataFrame:
    """A fitted table, written and read back.

    The optimizer then knows its real size in bytes and decides by its own threshold
    whether a join broadcasts it; nothing of it passes through the driver.
    """
    return materialize(df, label)


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A local relation from a few rows (``createDataFrame`` on a list would hide its size)."""
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=schema.names), schema)
