"""How long attempts and actions take, and features of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.columns import floor_ratio, mean_seconds, seconds_between
from logloom.operators.prepare import preprocess, real_items
from logloom.operators.timeline import along
from logloom.schema import ATTEMPT, DURATION, ITEM, ITEMS, TIME, scope, subject
from logloom.session import settle

VERB_DURATION = "verb_duration"
LEVEL = "duration_level"
VALID_Z = -1.5


def beside(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Put statistics of each log next to its rows.

    `stats` has one row per (task, batch), a handful at most, so it is broadcast; for a
    single log it is one row and becomes scalar subqueries.
    """
    if by:
        return df.join(F.broadcast(stats), list(by))
    return df.select("*", *[stats.select(c).scalar().alias(c) for c in stats.columns])


def attempt_durations(numbered: DataFrame) -> DataFrame:
    """Seconds between the first and the last event of every attempt."""
    return (
        numbered.where(F.col(ATTEMPT).isNotNull())
        .groupBy(*subject(numbered), ITEM, ATTEMPT)
        .agg(seconds_between(F.min(TIME), F.max(TIME)).alias(DURATION))
    )


def item_attempt_stats(durations: DataFrame) -> DataFrame:
    """Number of attempts, their mean and their shortest time per student and item."""
    return durations.groupBy(*subject(durations), ITEM).agg(
        F.count(DURATION).alias("attempt_times"),
        mean_seconds(F.col(DURATION)).alias("attempt_mean_time"),
        F.min(DURATION).alias("attempt_min_time"),
    )


def item_duration_stats(durations: DataFrame, items: Sequence[str] = tuple(ITEMS)) -> DataFrame:
    """Mean and sample deviation of attempt time per item; can be kept for other logs."""
    return (
        real_items(durations, items)
        .groupBy(*scope(durations), ITEM)
        .agg(mean_seconds(F.col(DURATION)).alias("item_mean"), F.stddev_samp(DURATION).alias("item_std"))
    )


def item_duration_state(durations: DataFrame, items: Sequence[str] = tuple(ITEMS)) -> DataFrame:
    """What `item_duration_stats` needs of a log, to be kept and merged: per item `n`, `mean` and `m2`, the sum of squares about the mean."""
    return (
        real_items(durations, items)
        .groupBy(*scope(durations), ITEM)
        .agg(F.count(DURATION).alias("n"), mean_seconds(F.col(DURATION)).alias("mean"), (F.var_pop(DURATION) * F.count(DURATION)).alias("m2"))
        .where("n > 0")
    )


def merged_states(*states: DataFrame) -> DataFrame:
    """The state of all logs together, from the states of each: a new log needs no old one."""
    keys = [*scope(states[0]), ITEM]
    stacked = states[0]
    for state in states[1:]:
        stacked = stacked.unionByName(state)
    # A row per item and log.
    of_item = Window.partitionBy(*keys)
    centred = stacked.withColumn("_mean", F.sum(F.col("n") * F.col("mean")).over(of_item) / F.sum("n").over(of_item))
    apart = F.col("mean") - F.col("_mean")
    return centred.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2")
    )


def stats_of_state(state: DataFrame) -> DataFrame:
    """`item_duration_stats` of the logs that a state is of."""
    spread = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return state.select(*scope(state), ITEM, F.col("mean").alias("item_mean"), spread.alias("item_std"))


def with_zscore(
    durations: DataFrame,
    items: Sequence[str] = tuple(ITEMS),
    fitted: DataFrame | None = None,
) -> DataFrame:
    """Attempt time against all attempts at the item; null where they do not vary.

    The statistics have one row per listed item, so they are broadcast: a window by item
    would put a popular item's attempts into one task. Attempts are read twice, so they are
    written once, much shorter than the log they come from.
    """
    kept = settle(real_items(durations, items))
    stats = item_duration_stats(kept, items) if fitted is None else real_items(fitted, items)
    keys = [c for c in (*scope(kept), ITEM) if c in stats.columns]
    centred = F.col(DURATION) - F.col("item_mean")
    return (
        kept.join(F.broadcast(stats), keys)
        .withColumn("z", F.when(F.col("item_std") != 0, centred / F.col("item_std")))
        .drop("item_mean", "item_std")
    )


def student_time_stats(
    scored: DataFrame, items: Sequence[str] = tuple(ITEMS), valid_z: float = VALID_Z
) -> DataFrame:
    """Per student: share of items with a valid attempt, and mean and spread of times.

    The spread of z is the population form, that of seconds the sample form.
    """
    valid_items = F.count_distinct(F.when(F.col("z") > valid_z, F.col(ITEM)))
    return scored.groupBy(*subject(scored)).agg(
        (valid_items / F.lit(len(items))).alias("valid_question_attempt_percent"),
        mean_seconds(F.col(DURATION)).alias("question_attempt_mean_time"),
        F.stddev_samp(DURATION).alias("question_attempt_std_time"),
        F.avg("z").alias("scaled_question_attempt_mean_time"),
        F.stddev_pop("z").alias("scaled_question_attempt_std_time"),
    )


def melt(df: DataFrame, keys: Sequence[str], name: Column, measures: Sequence[str]) -> DataFrame:
    """One (keys, feature, value) row per measure; `name` may use the column `measure`."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]
    )
    return (
        df.withColumn("_pair", F.explode(pairs))
        .withColumns({"measure": F.col("_pair.measure"), "value": F.col("_pair.value")})
        .select(*keys, name.alias("feature"), "value")
    )


def time_features(
    log: DataFrame, items: Sequence[str] = tuple(ITEMS), fitted: DataFrame | None = None
) -> DataFrame:
    """All time features in long form (student, feature, value).

    x_<item>_<attempt> is the attempt's time; y_<measure>_<item> describes the student's
    attempts at the item; z_<measure> describes the student.
    """
    # Sort the log once and keep the much shorter table of attempts.
    return features_of_attempts(settle(attempt_durations(preprocess(log))), items, fitted)


def features_of_attempts(
    durations: DataFrame, items: Sequence[str] = tuple(ITEMS), fitted: DataFrame | None = None
) -> DataFrame:
    """All time features in long form, of a settled table of attempts: it has five uses."""
    keys = subject(durations)
    x = melt(durations, keys, F.concat_ws("_", F.lit("x"), ITEM, ATTEMPT), [DURATION])
    y = melt(
        item_attempt_stats(durations),
        keys,
        F.concat_ws("_", F.lit("y"), "measure", ITEM),
        ["attempt_times", "attempt_mean_time", "attempt_min_time"],
    )
    students = student_time_stats(with_zscore(durations, items, fitted), items)
    z = melt(
        students,
        keys,
        F.concat_ws("_", F.lit("z"), "measure"),
        [c for c in students.columns if c not in keys],
    )
    return x.unionByName(y).unionByName(z)


def feature_names(features: DataFrame) -> list[str]:
    """Sorted names of the features that occur, for use as columns.

    A wide table has as many columns as there are names, so a number beyond Spark's own
    limit for pivots is an error and never a silent cut.
    """
    limit = int(features.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    names = [r[0] for r in features.select("feature").distinct().limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} features: keep them in long form")
    return sorted(names)


def widen(
    features: DataFrame,
    names: Sequence[str] | None = None,
    students: DataFrame | None = None,
    zero: Sequence[str] = ("x_", "y_", "m_"),
) -> DataFrame:
    """One row per student and one column per feature.

    Features that count or measure attempts are 0 where the student made none; others
    stay null. `students` adds rows for students without any feature.
    """
    names = list(names) if names is not None else feature_names(features)
    keys = subject(features)
    wide = features.groupBy(*keys).pivot("feature", names).agg(F.first("value"))
    if students is not None:
        wide = students.select(*keys).distinct().join(wide, keys, "left")
    return wide.fillna(0, [n for n in names if n.startswith(tuple(zero))])


def with_verb_duration(log: DataFrame) -> DataFrame:
    """Seconds until the student's next event if that is on the same item, else 0."""
    after = along(log, following={"_item": F.col(ITEM), "_time": F.col(TIME)})
    same = F.col("_item") == F.col(ITEM)
    return after.withColumn(
        VERB_DURATION,
        F.when(same, seconds_between(F.col(TIME), F.col("_time"))).otherwise(F.lit(0.0)),
    ).drop("_item", "_time")


def with_duration_level(
    log: DataFrame,
    target: str = VERB_DURATION,
    by: Sequence[str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """`target` in whole units of its spread: deviation / 10 per group, / 2000 over the log."""
    spread = F.stddev_samp(target)
    if by:
        keys = [*scope(log), *(c for c in by if c not in scope(log))]
        # Written first, the units have a known size when the join is planned: while they are
        # small the events stay where they are.
        units = settle(log.groupBy(*keys).agg((spread / F.lit(parts or 10)).alias("_unit")))
        measured = log.join(units, keys, "left")
    else:
        keys = scope(log)
        units = log.groupBy(*keys).agg((spread / F.lit(parts or 2000)).alias("_unit"))
        measured = beside(log, units, keys)
    return measured.withColumn(LEVEL, floor_ratio(F.col(target), F.col("_unit"))).drop("_unit")
