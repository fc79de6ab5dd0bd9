"""Cleaning of the verb-specific extra information of an event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: verbs and the patterns of their extra information. -----------------
CHOICE_PATTERN = r"^.*?_(\d):.*$"
ELIMINATED_PATTERN = r"^.*?_(\d:.*$)"
SCROLL_PATTERN = r"^(\d*),(.*?),.*$"
DROPPED_WORD = "source"
BLANKED_VERBS = [
    "Calculator Buffer",
    "Open Calculator",
    "Close Calculator",
    "Equation Editor Button",
    "Math Keypress",
    "Move Calculator",
    "TextToSpeech",
    "Yes",
    "No",
]
SCROLL_VERBS = ["Horizontal Item Scroll", "Vertical Item Scroll"]
# --- End of fixed values. -------------------------------------------------------------


def chosen_option(info: Column) -> Column:
    return F.regexp_extract(info, CHOICE_PATTERN, 1)


def eliminated_option(info: Column) -> Column:
    return F.regexp_extract(info, ELIMINATED_PATTERN, 1)


def dropped_count(info: Column) -> Column:
    return F.regexp_count(info, F.lit(DROPPED_WORD)).cast("string")


def scroll_range(info: Column) -> Column:
    """ "<first>_<second>" of a scroll; null, and not "_", where either is missing."""
    parts = [F.regexp_extract(info, SCROLL_PATTERN, g) for g in (1, 2)]
    return F.when(info.rlike(SCROLL_PATTERN), F.concat_ws("_", *parts))


def clean_info(verb: Column, info: Column) -> Column:
    """The part of the information that tells events of one verb apart, or ""."""
    return F.coalesce(
        F.when(verb.isin(*BLANKED_VERBS), F.lit(None).cast("string"))
        .when(verb == "Click Choice", chosen_option(info))
        .when(verb == "DropChoice", dropped_count(info))
        .when(verb == "Eliminate Choice", eliminated_option(info))
        .when(verb.isin(*SCROLL_VERBS), scroll_range(info))
        .otherwise(info),
        F.lit(""),
    )
