"""What students do in an attempt or a minute: verb chains, tokens and series."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.prepare import base_clean, group_verbs, preprocess, with_occurrence
from logloom.operators.timeline import SLICE, along, cut, is_cut, number_rows, settled
from logloom.operators.timing import LEVEL, beside, with_duration_level, with_verb_duration
from logloom.schema import (
    ATTEMPT,
    ITEM,
    ITEM_TYPE,
    ORDER,
    VERB,
    VERB_RUN,
    scope,
    subject,
)
from logloom.session import settle

CHAIN = "verb_chain"
OTHER = "OtherActions"


def verb_chains(numbered: DataFrame) -> DataFrame:
    """The distinct verbs of each attempt, sorted and joined by commas."""
    verbs = F.array_sort(F.collect_set(VERB))
    return (
        numbered.where(F.col(ATTEMPT).isNotNull() & F.col(VERB).isNotNull())
        .groupBy(*subject(numbered), ITEM, ATTEMPT)
        .agg(F.array_join(verbs, ",").alias(CHAIN))
    )


def chain_counts(chains: DataFrame) -> DataFrame:
    return chains.groupBy(*scope(chains), ITEM, CHAIN).agg(F.count(F.lit(1)).alias("attempts"))


def top_chains(chains: DataFrame, top: int = 10, support: int = 20) -> DataFrame:
    """Each item's most frequent chains that occur in more than `support` attempts.

    Equal counts are ordered by name. The window ranks counted chains, not attempts, and
    rare ones, which come after all others, are dropped before it.
    """
    ranked = Window.partitionBy(*scope(chains), ITEM).orderBy(F.desc("attempts"), CHAIN)
    return (
        chain_counts(chains)
        .where(F.col("attempts") > support)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= top)
    )


def with_common_chains(chains: DataFrame, top: int = 10, support: int = 20) -> DataFrame:
    """Chains outside the item's top list become "OtherActions".

    Attempts are read twice, so they are written once. So is the list, at most `top` rows per
    item: its size is known when the join is planned.
    """
    chains = settle(chains)
    keys = [*scope(chains), ITEM, CHAIN]
    common = settle(top_chains(chains, top, support).select(*keys, F.lit(True).alias("_common")))
    marked = chains.join(common, keys, "left")
    return marked.withColumn(
        CHAIN, F.when(F.col("_common"), F.col(CHAIN)).otherwise(F.lit(OTHER))
    ).drop("_common")


def chain_features(
    chains: DataFrame, top: int = 10, support: int = 20, least: int = 10
) -> DataFrame:
    """How often each student shows a feature m_<item>_<attempt>_<chain>.

    Features shown fewer than `least` times in the whole log are dropped.
    """
    named = with_common_chains(chains, top, support).withColumn(
        "feature", F.concat_ws("_", F.lit("m"), ITEM, ATTEMPT, CHAIN)
    )
    counts = named.groupBy(*subject(named), "feature").agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )
    keys = [*scope(named), "feature"]
    frequent = named.groupBy(*keys).count().where(F.col("count") >= least).drop("count")
    return counts.join(frequent, keys, "left_semi")


def behaviour_features(
    log: DataFrame, top: int = 10, support: int = 20, least: int = 10
) -> DataFrame:
    """All behaviour features in long form (student, feature, value)."""
    return chain_features(verb_chains(preprocess(log)), top, support, least)


def first_of_runs(numbered: DataFrame) -> DataFrame:
    """The first event of each verb run: the group minimum of (time, seq, rest of the row)."""
    keys = [*subject(numbered), ITEM, ITEM_TYPE, ATTEMPT, VERB_RUN]
    if is_cut(numbered):
        # A run across a slice border starts in the lower slice, where its first event is.
        keep = [SLICE, VERB]
    else:
        keep = [VERB]
    row = F.struct(*ORDER, *keep)
    return (
        numbered.where(F.col(ATTEMPT).isNotNull() & F.col(ITEM_TYPE).isNotNull())
        .groupBy(*keys)
        .agg(F.min(row).alias("_row"))
        .select(*keys, "_row.*")
    )


def verb_time_tokens(numbered: DataFrame) -> DataFrame:
    """Each student's verb runs in order as tokens <item>_<verb>_(<duration level>)."""
    timed = with_verb_duration(settled(first_of_runs(numbered)))
    levelled = with_duration_level(timed)
    level = F.col(LEVEL).try_cast("long").cast("string")
    token = F.concat(ITEM, F.lit("_"), VERB, F.lit("_("), level, F.lit(")"))
    placed = number_rows(settled(levelled.withColumn("token", token)))
    kept = [c for c in (*subject(placed), SLICE) if c in placed.columns]
    return placed.select(*kept, "position", "token")


def padded_spans(tokens: DataFrame, fills: Mapping[str, str | float]) -> DataFrame:
    """Sequences up to the longest one, as spans (start, end) of positions with equal values.

    A student's own positions are spans of one, and one more span of `fills` reaches to the
    longest sequence's end, so there is one row more per student at most. Train and hidden
    logs of one batch share the longest length.
    """
    keys = subject(tokens)
    sets = [c for c in scope(tokens) if c != "task"]
    lengths = tokens.groupBy(*keys).agg(F.max("position").alias("_last"))
    longest = lengths.groupBy(*sets).agg(F.max("_last").alias("_longest"))
    filler = beside(lengths, longest, sets).where("_last < _longest").select(
        *keys,
        (F.col("_last") + 1).alias("start"),
        F.col("_longest").alias("end"),
        *[F.lit(fill).cast(tokens.schema[name].dataType).alias(name) for name, fill in fills.items()],
    )
    own = tokens.select(*keys, F.col("position").alias("start"), F.col("position").alias("end"), *fills)
    return own.unionByName(filler)


def expanded(spans: DataFrame, name: str) -> DataFrame:
    """One row per position of each span."""
    return positions_between(spans, F.col("start"), F.col("end"), name).drop("start", "end")


def padded(tokens: DataFrame, value: str = "token", fill: str | float = "") -> DataFrame:
    """`padded_spans` of one column as rows: students x longest sequence of them."""
    return expanded(padded_spans(tokens, {value: fill}), "position")


def positions_between(
    df: DataFrame, first: Column, last: Column, name: str, block: int = 1000
) -> DataFrame:
    """One row per whole number from `first` to `last`, made in two steps of short lists."""
    blocks = F.sequence(F.floor(first / block).cast("long"), F.floor(last / block).cast("long"))
    start = F.greatest(F.col("_block") * block, first.cast("long"))
    end = F.least(F.col("_block") * block + block - 1, last.cast("long"))
    return (
        df.withColumn("_block", F.explode(blocks))
        .withColumn(name, F.explode(F.sequence(start, end)))
        .drop("_block")
    )


def minute_events(
    log: DataFrame, minute_seconds: int = 60, below: float = 10, parts: int = 2000
) -> DataFrame:
    """Clean events with verb groups, their minute and duration level; long ones dropped."""
    clean = base_clean(group_verbs(log))
    timed = settled(with_occurrence(clean, "minute", minute_seconds))
    levelled = with_duration_level(settled(with_verb_duration(timed)), parts=parts)
    return levelled.where(F.col(LEVEL) < below)


def minute_summary(events: DataFrame) -> DataFrame:
    """Per student and minute: total level, number of verbs, distinct verbs and their list."""
    verbs = F.array_sort(F.collect_set(VERB))
    summary = events.groupBy(*subject(events), "minute").agg(
        F.sum(LEVEL).alias("duration_level"),
        F.count(F.lit(1)).alias("verb_count"),
        verbs.alias("unique_verbs"),
    )
    return summary.withColumn("unique_verb_count", F.size("unique_verbs").cast("long"))


def minute_spans(summary: DataFrame) -> DataFrame:
    """Every student's minutes up to the log's last as spans (start, end), zeros where nothing happened.

    Minutes with events are spans of one, stretches without any one span each. Train and
    hidden logs of one batch share the last minute. `unique_verb_chain` is the text form of
    the verb list, "0" in empty minutes.
    """
    keys = subject(summary)
    sets = [c for c in scope(summary) if c != "task"]
    last = summary.groupBy(*sets).agg(F.max("minute").alias("_end"))
    valued = summary.withColumn("unique_verb_chain", F.to_json("unique_verbs")).drop("unique_verbs")
    minute = F.col("minute")
    placed = along(
        cut(valued, by=keys, order=["minute"]),
        by=keys,
        previous={"_before": minute},
        following={"_next": minute},
        order=["minute"],
    )

    def span(start: Column, end: Column, values: Mapping[str, Column]) -> Column:
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), *[v.alias(n) for n, v in values.items()])

    empty = {
        "duration_level": F.lit(0.0),
        "verb_count": F.lit(0).cast("long"),
        "unique_verb_count": F.lit(0).cast("long"),
        "unique_verb_chain": F.lit("0"),
    }
    own = span(minute, minute, {n: F.coalesce(F.col(n), zero) for n, zero in empty.items()})
    first = F.when(F.col("_before").isNull() & (minute > 0), span(F.lit(0), minute - 1, empty))
    until = F.coalesce(F.col("_next") - 1, F.col("_end"))
    gap = F.when(until > minute, span(minute + 1, until, empty))
    return beside(placed, last, sets).select(*keys, F.inline(F.array_compact(F.array(first, own, gap))))


def minute_series(summary: DataFrame) -> DataFrame:
    """`minute_spans` as rows: every student in every minute."""
    return expanded(minute_spans(summary), "minute")


def minute_tensor(spans: DataFrame, block: int = 1000) -> DataFrame:
    """Per student the spans of minutes in order as structs, in blocks by the minute they start at."""
    keys = subject(spans)
    cells = F.struct("start", "end", "duration_level", "verb_count", "unique_verb_count", "unique_verb_chain")
    return (
        spans.withColumn("block", F.floor(F.col("start") / block).cast("long"))
        .groupBy(*keys, "block")
        .agg(F.array_sort(F.collect_list(cells)).alias("minutes"))
    )
