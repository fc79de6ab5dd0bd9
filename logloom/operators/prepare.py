"""From raw events to a clean log with attempts and verb runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.columns import changed, micros_between, parse_time, verb_group, whole_units
from logloom.operators.timeline import along, settled
from logloom.schema import (
    ATTEMPT,
    BATCH_LIMITS,
    ITEM,
    ITEMS,
    NAVIGATION_VERB,
    NON_ITEM_PAGES,
    TIME,
    VERB,
    VERB_RUN,
    subject,
)


def with_parsed_time(log: DataFrame, pattern: str | None = None) -> DataFrame:
    """Text event times become time stamps; unreadable ones become null."""
    return log.withColumn(TIME, parse_time(F.col(TIME), pattern))


def with_elapsed(log: DataFrame, name: str = "elapsed_micros") -> DataFrame:
    """Microseconds since the student's first event."""
    timed = along(log, overall={"_first": (F.min, F.col(TIME))})
    return timed.withColumn(name, micros_between(F.col("_first"), F.col(TIME))).drop("_first")


def cut_to_batches(
    log: DataFrame, limits: Mapping[str, int | None] = BATCH_LIMITS
) -> DataFrame:
    """One copy of each event per batch whose time limit it keeps, marked by `batch`."""
    timed = with_elapsed(log)
    batches = F.array_compact(
        F.array(
            *[
                F.lit(batch)
                if limit is None
                else F.when(F.col("elapsed_micros") <= limit * 1_000_000, F.lit(batch))
                for batch, limit in limits.items()
            ]
        )
    )
    return timed.withColumn("batch", F.explode(batches)).drop("elapsed_micros")


def base_clean(
    log: DataFrame,
    verb: str = NAVIGATION_VERB,
    pages: Sequence[str] = tuple(NON_ITEM_PAGES),
) -> DataFrame:
    """Drop navigation events and events on pages that are no items; keep null values."""
    on_page = F.coalesce(F.col(ITEM).isin(*pages), F.lit(False))
    return log.where(~F.col(VERB).eqNullSafe(verb) & ~on_page)


def real_items(log: DataFrame, items: Sequence[str] = tuple(ITEMS)) -> DataFrame:
    return log.where(F.col(ITEM).isin(*items))


def group_verbs(log: DataFrame, groups: Mapping[str, str] | None = None) -> DataFrame:
    return log.withColumn(VERB, verb_group(F.col(VERB), groups))


def with_attempts(log: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Number each student's visits to an item, and the runs of one verb inside a visit.

    A visit ends when the next event is on another item. Events without an item end a
    visit too, and belong to none. `by` are the columns that tell time lines apart.
    """
    by = list(by or subject(log))
    before = along(log, by=by, previous={"_item": F.col(ITEM), "_verb": F.col(VERB)})
    flagged = before.withColumns(
        {"_item_start": changed(F.col(ITEM), F.col("_item"))}
    ).withColumns(
        {"_verb_start": F.col("_item_start") | changed(F.col(VERB), F.col("_verb"))}
    )
    counted = settled(
        along(
            flagged.drop("_item", "_verb"),
            by=by,
            running={"_verb_starts": F.col("_verb_start").cast("long")},
        )
    )
    based = along(
        counted, by=by, latest={"_base": F.when(F.col("_item_start"), F.col("_verb_starts"))}
    )
    numbered = along(
        based,
        by=[*by, ITEM],
        running={ATTEMPT: F.col("_item_start").cast("int")},
        source=counted,
    )
    has_item = F.col(ITEM).isNotNull()
    return numbered.withColumns(
        {
            ATTEMPT: F.when(has_item, F.col(ATTEMPT)).cast("int"),
            VERB_RUN: F.when(has_item, F.col("_verb_starts") - F.col("_base") + 1).cast("int"),
        }
    ).drop("_item_start", "_verb_start", "_verb_starts", "_base")


def preprocess(log: DataFrame) -> DataFrame:
    """Clean the log and number its attempts."""
    return with_attempts(base_clean(log))


def with_occurrence(log: DataFrame, name: str, unit_seconds: int) -> DataFrame:
    """Whole units of time between the student's first event and this one."""
    timed = with_elapsed(log)
    return timed.withColumn(name, whole_units(F.col("elapsed_micros"), unit_seconds)).drop(
        "elapsed_micros"
    )
