"""Events of each student and item as nested JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators.timeline import in_blocks, number_rows
from logloom.schema import INFO, ITEM, LABEL, STUDENT, TIME, VERB, subject

EVENTS = "events"
BLOCK = 1000
#: Event times keep their microseconds; they are in the session's time zone, which `tune` sets.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
FORMATS = {"timestampFormat": TIME_FORMAT, "timestampNTZFormat": TIME_FORMAT}

DOCUMENT = T.StructType(
    [
        T.StructField(STUDENT, T.LongType()),
        T.StructField(LABEL, T.BooleanType()),
        T.StructField(ITEM, T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField(
            EVENTS,
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("action", T.StringType()),
                        T.StructField("info", T.StringType()),
                        T.StructField("time", T.TimestampType()),
                    ]
                )
            ),
        ),
    ]
)


def student_logs(
    placed: DataFrame, roster: DataFrame | None = None, size: int = BLOCK
) -> DataFrame:
    """Documents (student, label, item, block, events) from events with their item in force.

    A student's events at an item come in blocks of at most `size`, numbered upwards, so no
    document outgrows a row. Students on the roster without events get one without an item.
    """
    keys = subject(placed)
    event = F.struct(
        F.col(VERB).alias("action"), F.col(INFO).alias("info"), F.col(TIME).alias("time")
    )
    documents = in_blocks(number_rows(placed), [*keys, ITEM], event, name=EVENTS, size=size)
    if roster is None:
        return documents
    return roster.join(documents, keys, "left")


def write_student_logs(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").options(**FORMATS).json(path)


def read_student_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).options(**FORMATS).json(path)


def events_of(documents: DataFrame) -> DataFrame:
    """Back to one row per event, in order by (block, place)."""
    kept = [c for c in (*subject(documents), LABEL, ITEM, "block") if c in documents.columns]
    return documents.select(*kept, F.posexplode(EVENTS).alias("place", "event")).select(
        *kept, "place", "event.*"
    )
