from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from logloom.schema import EVENT_SCHEMA  # noqa: E402
from logloom.session import discard, tune  # noqa: E402

START = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("logloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    discard(session)
    session.stop()


@pytest.fixture(scope="session")
def make_log(spark):
    """Events from (student, second, item, verb[, info[, type]]) tuples, in that order."""

    def make(rows) -> DataFrame:
        events = []
        for seq, row in enumerate(rows):
            student, second, item, verb, *rest = row
            info = rest[0] if rest else None
            kind = rest[1] if len(rest) > 1 else ("MCSS" if item else None)
            time = None if second is None else START + timedelta(seconds=second)
            events.append((student, seq, item, kind, verb, info, time))
        return spark.createDataFrame(events, EVENT_SCHEMA)

    return make


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    """Rows of the columns, sorted."""
    found = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


def in_order(df: DataFrame, column: str, *by: str) -> list:
    return [r[column] for r in df.orderBy(*(by or ("student_id", "event_time", "seq"))).collect()]
