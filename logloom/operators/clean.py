"""Turns raw events into events with one combined verb."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.info import clean_info
from logloom.operators.timeline import SLICE
from logloom.schema import INFO, ITEM, ITEM_TYPE, SEQ, TIME, VERB, subject


def clean_log(log: DataFrame) -> DataFrame:
    """Verb and its cleaned information joined by "_"; events without a time are dropped."""
    combined = F.concat(VERB, F.lit("_"), clean_info(F.col(VERB), F.col(INFO)))
    kept = [c for c in (*subject(log), SLICE) if c in log.columns]
    return log.where(F.col(TIME).isNotNull()).select(
        *kept, SEQ, TIME, ITEM, ITEM_TYPE, combined.alias(VERB)
    )
