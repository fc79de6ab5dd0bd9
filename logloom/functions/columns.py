"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.schema import VERB_GROUPS

MICROS = 1_000_000


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def seconds_between(start: Column, end: Column) -> Column:
    """Exact time difference in seconds, over any number of days."""
    return micros_between(start, end) / F.lit(float(MICROS))


def mean_seconds(seconds: Column) -> Column:
    """Mean of times, from their exact sum: the same in whatever order rows arrive."""
    total = F.sum(seconds.cast("decimal(22,6)"))
    return total.cast("double") / F.count(seconds)


def whole_units(micros: Column, unit_seconds: int) -> Column:
    """How many whole units of `unit_seconds` fit into a non-negative time span."""
    unit = F.lit(unit_seconds * MICROS)
    return ((micros - micros % unit) / unit).cast("long")


def verb_group(verb: Column, groups: dict[str, str] | None = None) -> Column:
    """The verb's group, or the verb itself where it has none."""
    pairs = [F.lit(x) for pair in (groups or VERB_GROUPS).items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[verb], verb)


def changed(value: Column, before: Column) -> Column:
    """True where a run starts: the value differs from the one before, or either is null."""
    return F.coalesce(value != before, F.lit(True))


def parse_time(text: Column, pattern: str | None = None) -> Column:
    """Text to time stamp; null where the text is not a time."""
    return F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)


def floor_ratio(value: Column, unit: Column) -> Column:
    """floor(value / unit) as a double; 0 where undefined, infinite where only the unit is 0."""
    return (
        F.when(value.isNull() | unit.isNull(), F.lit(0.0))
        .when(unit != 0, F.floor(F.try_divide(value, unit)).cast("double"))
        .when(value == 0, F.lit(0.0))
        .otherwise(F.lit(float("inf")))
    )
