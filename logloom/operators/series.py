"""Series on a grid of seconds, and per-student arrays of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.columns import MICROS, whole_units
from logloom.operators.clean import clean_log
from logloom.operators.prepare import with_elapsed
from logloom.operators.timeline import SLICE, along, settled
from logloom.operators.timing import VERB_DURATION
from logloom.schema import GRID_SECONDS, ITEM, ITEM_TYPE, ORDER, VERB, subject

SECOND = "occur_second"
MASK = "0"
MASKED = (ITEM, ITEM_TYPE, VERB)


def second_bins(clean: DataFrame, time_bin: int = 1, limit: int = GRID_SECONDS) -> DataFrame:
    """Bin of each event and the time to the student's next event, both in `time_bin` seconds.

    The time to the next event is taken before events after `limit` seconds are dropped,
    and is 0 at the student's last event.
    """
    timed = settled(with_elapsed(clean))
    after = along(timed, following={"_next": F.col("elapsed_micros")})
    bins = after.withColumns(
        {
            SECOND: whole_units(F.col("elapsed_micros"), time_bin),
            VERB_DURATION: F.coalesce(F.col("_next") - F.col("elapsed_micros"), F.lit(0))
            / F.lit(float(time_bin * MICROS)),
        }
    )
    return bins.where(F.col(SECOND) <= limit // time_bin).drop("_next", "elapsed_micros")


def last_per_second(bins: DataFrame) -> DataFrame:
    """The last non-null value of each column per student and bin."""
    at = F.struct(*ORDER)

    def last_of(name: str):
        column = F.col(name)
        return F.max_by(column, F.when(column.isNotNull(), at)).alias(name)

    return bins.groupBy(*subject(bins), SECOND).agg(
        *[last_of(c) for c in (*MASKED, VERB_DURATION)]
    )


def series_spans(seconds: DataFrame, time_bin: int = 1, limit: int = GRID_SECONDS) -> DataFrame:
    """The dense series of each student as spans of bins (start, end) with equal values.

    A value holds until the next one; after the student's last bin, item, type and verb are
    "0" and the duration keeps its last value. Spans cover every bin from 0 to
    limit / time_bin, yet there are no more of them than observed bins plus one, and a
    student has a bounded number of bins, so plain windows do.
    """
    rows = Window.partitionBy(*subject(seconds)).orderBy(SECOND)
    so_far = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = (*MASKED, VERB_DURATION)
    filled = seconds.withColumns(
        {c: F.last(c, ignorenulls=True).over(so_far) for c in values}
        | {"_next": F.lead(SECOND).over(rows)}
    )
    return _spans(filled, time_bin, limit)


def _spans(filled: DataFrame, time_bin: int, limit: int) -> DataFrame:
    """Spans of observed bins with the values that hold there, and the student's next bin as `_next`."""
    values = (*MASKED, VERB_DURATION)
    end = F.lit(limit // time_bin).cast("long")
    own = F.struct(
        F.col(SECOND).alias("start"),
        F.coalesce(F.col("_next") - 1, F.col(SECOND)).alias("end"),
        *values,
    )
    masked = F.struct(
        (F.col(SECOND) + 1).alias("start"),
        end.alias("end"),
        *[F.lit(MASK).alias(c) for c in MASKED],
        VERB_DURATION,
    )
    rest = F.when(F.col("_next").isNull() & (F.col(SECOND) < end), masked)
    return filled.select(
        *subject(filled), F.inline(F.array_compact(F.array(own, rest)))
    )


def filled_bins(bins: DataFrame) -> DataFrame:
    """`bins` with, as `_last_...`, the last non-null value of each column up to an event, and as `_next` the bin of the next one.

    They follow the order that binning sorts by, so they cost no other sort.
    """
    latest = {f"_last_{c}": F.col(c) for c in (*MASKED, VERB_DURATION)}
    return along(settled(bins), latest=latest, following={"_next": F.col(SECOND)})


def spans_of_bins(filled: DataFrame, time_bin: int = 1, limit: int = GRID_SECONDS) -> DataFrame:
    """`series_spans` of `last_per_second`, from `filled_bins`: the last event of a bin has its values."""
    last = filled.where(F.col("_next").isNull() | (F.col("_next") != F.col(SECOND)))
    values = [F.col(f"_last_{c}").alias(c) for c in (*MASKED, VERB_DURATION)]
    return _spans(last.select(*subject(filled), SECOND, "_next", *values), time_bin, limit)


def second_series(log: DataFrame, time_bin: int = 1, limit: int = GRID_SECONDS) -> DataFrame:
    """From raw events to the spans of each student's dense series."""
    return spans_of_bins(filled_bins(second_bins(clean_log(log), time_bin, limit)), time_bin, limit)


def dense_rows(spans: DataFrame) -> DataFrame:
    """One row per student and bin."""
    return spans.withColumn(SECOND, F.explode(F.sequence("start", "end"))).drop("start", "end")


def series_arrays(spans: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per student with each column's value in every bin, in order.

    The grid bounds the length of the lists, which are made without its rows.
    """
    gathered = spans.groupBy(*subject(spans)).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", *columns))).alias("_spans")
    )

    def values(column: str) -> Column:
        def repeat(span: Column) -> Column:
            length = (span["end"] - span["start"] + 1).cast("int")
            return F.array_repeat(span[column], length)

        return F.flatten(F.transform("_spans", repeat)).alias(column)

    return gathered.select(*subject(spans), *[values(c) for c in columns])


def wide_series(spans: DataFrame, column: str, limit: int) -> DataFrame:
    """One row per student and one column per bin 0..limit, for a single series."""
    return (
        dense_rows(spans)
        .groupBy(*subject(spans))
        .pivot(SECOND, list(range(limit + 1)))
        .agg(F.first(column, ignorenulls=True))
    )


def stacked(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Join per-student arrays of several features into one array of structs.

    Each frame holds its array in the column of its name. Arrays of one student must have
    equal lengths. Files of long runs of equal values are a hundredth of their rows and less, so
    the joins are sorted ones: by the files' size, Spark would send whole arrays through the driver.
    """
    names = list(frames)
    keys = subject(frames[names[0]])
    joined = reduce(
        lambda a, b: a.hint("merge").join(b.hint("merge"), keys),
        (f.select(*keys, n) for n, f in frames.items()),
    )
    sizes = F.array_distinct(F.array(*[F.size(n) for n in names]))
    checked = F.when(F.size(sizes) == 1, F.arrays_zip(*names)).otherwise(
        F.raise_error(F.lit("series of one student differ in length"))
    )
    return joined.select(*keys, checked.alias("series"))


def weight_series(
    weighted: DataFrame, time_bin: int = 1, limit: int = GRID_SECONDS
) -> DataFrame:
    """One row per event with its whole verb weight and its duration, still in time order."""
    bins = second_bins(weighted, time_bin, limit)
    kept = [c for c in (*subject(bins), SLICE) if c in bins.columns]
    return bins.select(
        *kept, *ORDER, SECOND, F.col("verb_weight").cast("int").alias("verb_weight"), VERB_DURATION
    )
