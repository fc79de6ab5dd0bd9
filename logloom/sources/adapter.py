"""Reads the `events` table of the test data as an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.schema import (
    BLANK,
    BLANKS,
    CHOICE,
    COMPOSITE,
    INFO,
    ITEM,
    ITEM_TYPE,
    LABEL,
    MATCH,
    SEQ,
    STUDENT,
    TIME,
    VERB,
)

#: One second of the timed test stands for this many seconds of the 30-day event stream.
SECOND = 1440
ITEMS = ["IT00", "IT01", "IT02", "IT03"]
BATCH_LIMITS = {"10": 600 * SECOND, "20": 1200 * SECOND, "30": None}

ANSWERS = {
    "IT00": (BLANK, [["5"]]),
    "IT01": (BLANKS, [["3"], ["5"], ["6"], ["7"], ["8"]]),
    "IT02": (COMPOSITE, [["0"], ["1"], ["2"]]),
    "IT03": (MATCH, [["2"], ["3"], ["1"], ["4"]]),
}
CHOICE_ANSWERS = {item: (CHOICE, [["2"]]) for item in ITEMS}


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    k = F.translate("props", '{}"k: ', "").cast("int")
    item_no = (F.floor((F.dayofmonth("ts") - 1) / 3) % 4).cast("int")
    item = F.concat(F.lit("IT0"), item_no.cast("string"))
    code = (
        F.when(k < 70, F.concat(F.lit("Digit"), (k % 10).cast("string")))
        .when(k < 80, "Period")
        .when(k < 95, "Backspace")
        .otherwise("KeyX")
    )
    part = F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("C")
    drop = F.format_string('[{"source":"%d","target":%d}]', k % 4 + 1, F.floor(k / 4).cast("int") % 4 + 1)
    press = F.format_string(
        '{"code":"%s","numericIdentifier":"%d","partId":"%s"}', code, k % 5 + 1, part
    )
    return events.select(
        F.col("user_id").alias(STUDENT),
        F.col("event_id").alias(SEQ),
        F.col("ts").alias(TIME),
        item.alias(ITEM),
        F.when(item_no == 0, "FillInBlank")
        .when(item_no == 1, "MultipleFillInBlank")
        .when(item_no == 2, "CompositeCR")
        .otherwise("MatchMS")
        .alias(ITEM_TYPE),
        F.when(kind == "signup", "Enter Item")
        .when(kind == "click", "Click Choice")
        .when(kind == "view", "Vertical Item Scroll")
        .when(kind == "error", "Click Progress Navigator")
        .when(item_no == 3, "DropChoice")
        .otherwise("Math Keypress")
        .alias(VERB),
        F.when(kind == "click", F.format_string("%s_%d:checked", item, k % 5 + 1))
        .when(kind == "view", F.format_string("%d,%d,0", k, k * 3))
        .when((kind == "purchase") & (item_no == 3), drop)
        .when(kind == "purchase", press)
        .alias(INFO),
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user in the log, in the order predictions are to be written."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias(STUDENT))
    return users.distinct().withColumn("ord", F.col(STUDENT))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster(spark, sf_dir).select(STUDENT, (F.col(STUDENT) % 2 == 1).alias(LABEL))


def is_train() -> Column:
    return F.col(STUDENT) % 4 != 0


def with_task(log: DataFrame) -> DataFrame:
    return log.withColumn("task", F.when(is_train(), "train").otherwise("hidden"))
