"""Saves encoded sequences and their dimensions per batch, and reads them back.

A save is a version: its files go to a folder of their own, and its manifest, with the rows and a checksum of each
batch and feature, is written last. Readers take the newest version that has a manifest, so a save that fails half way
leaves the one before in force, and readers that have begun keep their files. `prune` deletes older versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.behaviour import padded_spans
from logloom.operators.encode import (
    WEIGHT,
    encoded_series,
    encoding_dims,
    verb_weight_map,
    weights_of_bins,
)
from logloom.operators.clean import clean_log
from logloom.operators.series import MASKED, filled_bins, second_bins, spans_of_bins
from logloom.operators.timeline import blocks_of_spans, number_rows, settled
from logloom.operators.timing import VERB_DURATION
from logloom.schema import GRID_SECONDS, STUDENT, subject
from logloom.session import delete, settle
from logloom.sources.files import write_table

FEATURES, DIMS, MANIFEST = "features", "dims", "manifest"


def sequence_blocks(spans: DataFrame, columns: Sequence[str], size: int = 1000) -> DataFrame:
    """The columns' values per student in order, as blocks (block, values, feature): one shuffle for all of them."""
    values = F.struct(*[F.col(c).cast("double").alias(c) for c in columns])
    blocks = blocks_of_spans(spans, subject(spans), values, size=size)
    features = [F.struct(F.col("values")[c].alias("values"), F.lit(c).alias("feature")) for c in columns]
    return blocks.select(*subject(spans), "block", F.inline(F.array(*features)))


def save_all(
    log: DataFrame,
    labels: DataFrame,
    folder: str,
    time_bin: int = 1,
    limit: int = GRID_SECONDS,
    *,
    training_log: DataFrame,
) -> None:
    """Save all sequences of all batches and tasks, and the dimensions of each batch, as a new version.

    `log` holds train and hidden logs of every batch; code books are shared by the tasks of
    one batch. `training_log` gives the verb weights: the full log of the training students.
    The log is cleaned, sorted and binned once, for the series and the weights.
    """
    version = f"{folder}/{uuid.uuid4().hex}"
    filled = filled_bins(second_bins(clean_log(log), time_bin, limit))
    bins = settle(number_rows(settled(filled)))
    spans = settle(spans_of_bins(bins, time_bin, limit))
    write_table(encoding_dims(spans), f"{version}/{DIMS}")
    weights = settle(verb_weight_map(clean_log(training_log), labels))
    coded, _ = encoded_series(spans)
    coded = settle(coded)
    rows = settle(weights_of_bins(bins, weights))
    padded = settle(padded_spans(rows, {WEIGHT: 0, VERB_DURATION: 0.0}))
    stacked = sequence_blocks(coded, MASKED).unionByName(sequence_blocks(padded, (WEIGHT, VERB_DURATION)))
    write_table(stacked, f"{version}/{FEATURES}", ["task", "batch", "feature"])
    publish(log.sparkSession, folder, version)


def summary(spark: SparkSession, version: str) -> DataFrame:
    """`table`, `batch`, `feature`, `rows` and `checksum` of what a version's files hold, in whatever order."""
    tables = []
    for name, feature in ((FEATURES, F.col("feature")), (DIMS, F.col("feature_type"))):
        saved = spark.read.option("basePath", f"{version}/{name}").parquet(f"{version}/{name}")
        batch = F.col("batch").cast("string").alias("batch") if "batch" in saved.columns else F.lit(None).cast("string").alias("batch")
        columns = [F.col(c).cast("string") if c in ("task", "batch") else F.col(c) for c in sorted(saved.columns)]
        checksum = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("checksum")
        counted = saved.groupBy(F.lit(name).alias("table"), batch, feature.alias("feature"))
        tables.append(counted.agg(F.count(F.lit(1)).alias("rows"), checksum))
    return tables[0].unionByName(tables[1])


def publish(spark: SparkSession, folder: str, version: str) -> None:
    """Write the manifest of a version under the next number: from then on it is the one that is read."""
    number = max(manifests(spark, folder), default=0) + 1
    content = summary(spark, version).withColumn("version", F.lit(version))
    content.coalesce(1).write.parquet(f"{folder}/{MANIFEST}/{number}")


def manifests(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the manifests that are complete."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}/*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(status.getPath().getParent().getName()) for status in (found or []))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest in force."""
    numbers = manifests(spark, folder)
    if not numbers:
        raise FileNotFoundError(f"{folder} has no save: run save_all first")
    return spark.read.parquet(f"{folder}/{MANIFEST}/{numbers[-1]}")


def current(spark: SparkSession, folder: str) -> str:
    """The folder of the version in force."""
    row = manifest(spark, folder).select("version").first()
    if row is None:
        raise FileNotFoundError(f"{folder} has an empty save: run save_all with a log")
    return row[0]


def damages(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the manifest in force that its files don't have, and rows of the files that it doesn't."""
    noted = manifest(spark, folder).drop("version")
    found = summary(spark, current(spark, folder)).select(noted.columns)
    return noted.exceptAll(found).withColumn("side", F.lit("manifest")).unionByName(found.exceptAll(noted).withColumn("side", F.lit("files")))


def prune(spark: SparkSession, folder: str) -> int:
    """Delete all versions and manifests but those in force; how many there were."""
    old = manifests(spark, folder)[:-1]
    stays = current(spark, folder)
    for number in old:
        path = f"{folder}/{MANIFEST}/{number}"
        row = spark.read.parquet(path).select("version").first()
        if row is not None and row[0] != stays:
            delete(spark, row[0])
        delete(spark, path)
    return len(old)


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{current(spark, folder)}/{name}"
    return spark.read.option("basePath", path).parquet(path)


def read_sequences(
    spark: SparkSession, folder: str, batch: str, names: Sequence[str] = (WEIGHT, VERB_DURATION)
) -> DataFrame:
    """Saved sequence blocks (task, student, feature, block, values) of one batch."""
    saved = _read(spark, folder, FEATURES)
    wanted = (F.col("batch").cast("string") == batch) & F.col("feature").isin(*names)
    return saved.where(wanted).select("task", STUDENT, "feature", "block", "values")


def read_dims(spark: SparkSession, folder: str, batch: str) -> DataFrame:
    saved = _read(spark, folder, DIMS)
    return saved.where(F.col("batch").cast("string") == batch).select("feature_type", "dim")
