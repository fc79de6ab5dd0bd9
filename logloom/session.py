"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SETTINGS = {
    # Time stamps without a zone are read as UTC, so differences never cross a clock change.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split a hot join key even where that costs one more shuffle downstream.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows may hold long texts: what goes to a Python worker at once stays small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings this library counts on."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only on a local master that has none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="logloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/logloom-{spark.sparkContext.applicationId}"


#: Tables of the scopes that are open, innermost last.
_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession) -> str:
    """A new path for a table; it goes with the innermost open `scratch`, or with `discard`."""
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def settle(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there.

    Later steps prune its columns like any Parquet table's, and a lost executor costs
    no more than re-reading files. `schema` reads the same files as other types.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that were settled inside; results must be written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def discard(spark: SparkSession) -> None:
    """Delete all tables that this application has settled."""
    delete(spark, own_folder(spark))
