"""Computations along each student's time line that survive a student with most of the rows.

A plain window over one student runs in one task. That is the best plan while the student's
log fits a task, which `cut` checks with one counting job. Students whose logs do not are hot:
`cut` range-partitions their rows alone by (student, time, seq) into slices of about equal size, and
leaves all others as they are. `along` then works slice by slice, with everyone else's log as one slice:
windows inside a slice, one summary row per slice of the hot students, and the summaries of
earlier slices joined back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.schema import ORDER, subject
from logloom.session import settle

SLICE = "__slice"
GROUP = "_group"

#: Rows one task may hold of one student's log, and about the size of one slice.
MAX_ROWS = 2_000_000


def cut(
    log: DataFrame,
    max_rows: int = MAX_ROWS,
    by: Sequence[str] | None = None,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Put students (or other groups) with more than `max_rows` rows into slices, if there are any.

    Slices have a hidden column: 1, 2, ... for the rows of hot students, 0 for all others.
    `order` must be total within a group.
    """
    by = list(by or subject(log))
    group = F.struct(*by)
    load = log.groupBy(group.alias(GROUP)).count()
    # Most logs have no hot student: one number tells, and nothing is written.
    most = load.agg(F.max("count")).first()[0]
    if most is None or most <= max_rows:
        return log
    hot = settle(load.where(F.col("count") > max_rows))
    total = hot.agg(F.sum("count")).first()[0]
    # At most one row per `max_rows` rows of the log, with a known size when the joins are planned.
    marked = log.withColumn(GROUP, group)
    hot_rows = marked.join(hot, GROUP, "left_semi").drop(GROUP)
    others = marked.join(hot, GROUP, "left_anti").drop(GROUP).withColumn(SLICE, F.lit(0))
    # Slices follow the sort order, so a higher number is never earlier for the same student.
    ranged = hot_rows.repartitionByRange(math.ceil(total / max_rows), *by, *order)
    return settle(ranged.withColumn(SLICE, F.spark_partition_id() + 1).unionByName(others))


def is_cut(log: DataFrame) -> bool:
    return SLICE in log.columns


def settled(log: DataFrame) -> DataFrame:
    """End the lineage of a cut log between passes; leave a whole one alone."""
    return settle(log) if is_cut(log) else log


def along(
    log: DataFrame,
    by: Sequence[str] | None = None,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    latest: Mapping[str, Column] | None = None,
    overall: Mapping[str, tuple[Callable[[Column], Column], Column]] | None = None,
    order: Sequence[str] = ORDER,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add columns computed over each group's events in time order.

    previous, following: the value on the neighbouring event, null at the ends
    running: the sum up to and including this event
    latest: the last non-null value up to and including this event
    overall: an aggregate such as (F.min, column) over the whole group

    `source` has the same rows and the columns used here, if that is cheaper to read a
    second time than `log`, as the slices' summaries are made from it.
    """
    by = list(by or subject(log))
    previous, following = dict(previous or {}), dict(following or {})
    running, latest, overall = dict(running or {}), dict(latest or {}), dict(overall or {})
    parts = [GROUP, SLICE] if is_cut(log) else by
    here = Window.partitionBy(*parts).orderBy(*order)
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Ordered like the others, so that one sort serves all columns.
    everything = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    if not is_cut(log):
        return log.withColumns(
            {n: F.lag(c).over(here) for n, c in previous.items()}
            | {n: F.lead(c).over(here) for n, c in following.items()}
            | {n: F.sum(c).over(so_far) for n, c in running.items()}
            | {n: F.last(c, ignorenulls=True).over(so_far) for n, c in latest.items()}
            | {n: agg(c).over(everything) for n, (agg, c) in overall.items()}
        )

    # A struct tells "no neighbour in this slice" (null) from "its value is null".
    # A struct of the group's columns is equal to itself even where they are null.
    group = F.struct(*by).alias(GROUP)
    local = log.select("*", group).withColumns(
        {n: F.lag(F.struct(c.alias("v"))).over(here) for n, c in previous.items()}
        | {n: F.lead(F.struct(c.alias("v"))).over(here) for n, c in following.items()}
        | {n: F.sum(c).over(so_far) for n, c in running.items()}
        | {n: F.last(c, ignorenulls=True).over(so_far) for n, c in latest.items()}
        | {n: agg(c).over(everything) for n, (agg, c) in overall.items()}
    )
    at = F.struct(*order)
    summary = (source or log).where(F.col(SLICE) > 0).groupBy(group, SLICE).agg(
        F.count(F.lit(1)).alias("_events"),
        *[F.max_by(F.struct(c.alias("v")), at).alias(f"_{n}") for n, c in previous.items()],
        *[F.min_by(F.struct(c.alias("v")), at).alias(f"_{n}") for n, c in following.items()],
        *[F.sum(c).alias(f"_{n}") for n, c in running.items()],
        *[
            F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_{n}")
            for n, c in latest.items()
        ],
        *[agg(c).alias(f"_{n}") for n, (agg, c) in overall.items()],
    )
    slices = Window.partitionBy(GROUP).orderBy(SLICE)
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    all_slices = Window.partitionBy(GROUP)
    carried = summary.select(
        *parts,
        *[F.lag(f"_{n}").over(slices).alias(f"_{n}") for n in previous],
        *[F.lead(f"_{n}").over(slices).alias(f"_{n}") for n in following],
        *[F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in running],
        *[F.last(f"_{n}", ignorenulls=True).over(earlier).alias(f"_{n}") for n in latest],
        *[agg(F.col(f"_{n}")).over(all_slices).alias(f"_{n}") for n, (agg, _) in overall.items()],
    )
    both = local.join(carried, parts, "left").drop(GROUP)
    merged = (
        {n: F.coalesce(n, f"_{n}")["v"] for n in [*previous, *following]}
        | {
            n: F.when(F.col(n).isNull(), F.col(f"_{n}")).otherwise(
                F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))
            )
            for n in running
        }
        | {n: F.coalesce(n, f"_{n}") for n in latest}
        | {n: F.when(F.col(SLICE) > 0, F.col(f"_{n}")).otherwise(F.col(n)) for n in overall}
    )
    names = [*previous, *following, *running, *latest, *overall]
    return both.withColumns(merged).drop(*[f"_{n}" for n in names])


def in_blocks(
    log: DataFrame,
    keys: Sequence[str],
    value: Column,
    name: str = "values",
    position: str = "position",
    size: int = 1000,
) -> DataFrame:
    """Ordered lists of `value` per key, cut into blocks of at most `size` elements.

    `position` numbers the rows of one time line, so a block number is position // size
    and no list ever outgrows a row, however long the log.
    """
    numbered = log.withColumn("block", F.floor(F.col(position) / size).cast("long"))
    gathered = numbered.groupBy(*keys, "block").agg(
        F.array_sort(F.collect_list(F.struct(position, value.alias("v")))).alias("_rows")
    )
    return gathered.select(*keys, "block", F.col("_rows.v").alias(name))


def blocks_of_spans(
    spans: DataFrame, keys: Sequence[str], value: Column, name: str = "values", size: int = 1000
) -> DataFrame:
    """Lists as of `in_blocks`, from spans (start, end) of equal values: no row per position."""
    first, last = (F.floor(F.col(c) / size).cast("long") for c in ("start", "end"))
    pieces = spans.select(
        *keys, "start", "end", value.alias("_value"), F.explode(F.sequence(first, last)).alias("block")
    )
    start = F.greatest(F.col("start"), F.col("block") * size)
    length = F.least(F.col("end"), F.col("block") * size + size - 1) - start + 1
    gathered = pieces.groupBy(*keys, "block").agg(
        F.array_sort(F.collect_list(F.struct(start.alias("_at"), length.cast("int").alias("_n"), "_value"))).alias("_spans")
    )
    repeated = F.transform("_spans", lambda s: F.array_repeat(s["_value"], s["_n"]))
    return gathered.select(*keys, "block", F.flatten(repeated).alias(name))


def number_rows(
    log: DataFrame,
    by: Sequence[str] | None = None,
    order: Sequence[str] = ORDER,
    name: str = "position",
) -> DataFrame:
    """Position of each event on its time line, or of each row in its group, from 0."""
    counted = along(log, by=by, running={name: F.lit(1)}, order=order)
    return counted.withColumn(name, (F.col(name) - 1).cast("long"))
