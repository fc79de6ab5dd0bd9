"""Scores answers against the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.key import AnswerKey, accepted_of, kind_of, slots_of
from logloom.operators.answers import ANSWERED, SLOTS, STATUS, matrix
from logloom.schema import ANSWER_KEY, BLANK, ITEM, scope, subject

SCORE = "score"
#: Whether all slots are right.
RIGHT = "is_right"


def scored(answers: DataFrame, key: AnswerKey = ANSWER_KEY) -> DataFrame:
    """Number of right slots per student and item; null where there is no answer.

    One slot gives 0 or 1, so every kind of item is the same sum. Typed text of a single
    blank loses backslashes, then newlines, at both ends first.
    """
    bare = F.transform(SLOTS, lambda s: F.trim(F.trim(s, F.lit("\\")), F.lit("\n")))
    right = F.zip_with(
        F.when(kind_of(F.col(ITEM), key) == BLANK, bare).otherwise(F.col(SLOTS)),
        accepted_of(F.col(ITEM), key),
        lambda slot, accepted: F.coalesce(F.array_contains(accepted, slot).cast("int"), F.lit(0)),
    )
    total = F.aggregate(right, F.lit(0), lambda a, b: a + b)
    full = slots_of(F.col(ITEM), key)
    return answers.withColumns(
        {SCORE: F.when(F.col(STATUS) == ANSWERED, total), RIGHT: F.when(F.col(STATUS) == ANSWERED, total == full)}
    )


def score_matrix(scores: DataFrame, key: AnswerKey = ANSWER_KEY) -> DataFrame:
    """One row per student; a column per item with the score, N_A or N_D as text."""
    text = F.coalesce(F.col(SCORE).cast("string"), F.col(STATUS))
    return matrix(scores, text, list(key))


def item_right_share(scores: DataFrame) -> DataFrame:
    """Per item: students who answered, and the share who got every slot right."""
    return (
        scores.where(F.col(STATUS) == ANSWERED)
        .groupBy(*scope(scores), ITEM)
        .agg(
            F.count(F.lit(1)).alias("answered"),
            F.avg(F.col(RIGHT).cast("double")).alias("right_share"),
        )
    )


def conditional_option_share(scores: DataFrame, easiest: int) -> DataFrame:
    """Options of each item among students who got the `easiest` items all right.

    Items are ranked by their share of right answers, equal shares by name. An option is the
    text of all slots, "-" for an empty one, with bars between.
    """
    sets, keys = scope(scores), subject(scores)
    ranked = Window.partitionBy(*sets).orderBy(F.desc("right_share"), ITEM)
    if not sets:
        ranked = Window.partitionBy(F.lit(0)).orderBy(F.desc("right_share"), ITEM)
    # One row per item of the key reaches the ranking.
    easy = (
        item_right_share(scores)
        .withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= easiest)
        .select(*sets, ITEM)
    )
    passed = (
        scores.where(F.col(RIGHT))
        .join(easy, [*sets, ITEM])
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_right"))
        .where(F.col("_right") == easiest)
        .select(*keys)
    )
    options = (
        scores.where(F.col(STATUS) == ANSWERED)
        .join(passed, keys, "left_semi")
        .groupBy(*sets, ITEM, F.array_join(SLOTS, "|", "-").alias("option"))
        .agg(F.count(F.lit(1)).alias("students"), F.max(F.col(RIGHT).cast("int")).alias("is_right"))
    )
    of_item = Window.partitionBy(*sets, ITEM)
    total = F.sum("students").over(of_item)
    return options.withColumn("answered", total).withColumn(
        "share", F.col("students") / F.col("answered")
    )
