"""Column names, table schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STUDENT = "student_id"
SEQ = "seq"
ITEM = "item_id"
ITEM_TYPE = "item_type"
VERB = "observable"
INFO = "ext_info"
TIME = "event_time"
ATTEMPT = "attempt"
VERB_RUN = "verb_run"
DURATION = "duration"
LABEL = "label"

#: The order of events on a student's time line. `seq` is unique, so it is total.
ORDER = (TIME, SEQ)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField(STUDENT, T.LongType()),
        T.StructField(SEQ, T.LongType()),
        T.StructField(ITEM, T.StringType()),
        T.StructField(ITEM_TYPE, T.StringType()),
        T.StructField(VERB, T.StringType()),
        T.StructField(INFO, T.StringType()),
        T.StructField(TIME, T.TimestampType()),
    ]
)
KEY_SCHEMA = T.StructType(
    [
        T.StructField(ITEM, T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("accepted", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)

CHOICE, BLANK, BLANKS, COMPOSITE, MATCH = "choice", "blank", "blanks", "composite", "match"

# --- Fixed values: they must equal the source data's, or results differ. -------------

TRAIN, HIDDEN = "train", "hidden"

#: Seen but not answered; never visited.
NO_ANSWER, NOT_DONE = "N_A", "N_D"

ITEMS = [
    "VH098810",
    "VH098519",
    "VH098808",
    "VH139047",
    "VH098759",
    "VH098740",
    "VH134366",
    "VH098753",
    "VH134387",
    "VH098783",
    "VH098812",
    "VH139196",
    "VH134373",
    "VH098839",
    "VH098597",
    "VH098556",
    "VH098779",
    "VH098834",
    "VH098522",
]

#: Items whose answers become one-hot features.
RESPONSE_FEATURE_ITEMS = ["VH098519", "VH098808", "VH098759", "VH098740", "VH098783"]

NAVIGATION_VERB = "Click Progress Navigator"
NON_ITEM_PAGES = ["BlockRev", "EOSTimeLft", "HELPMAT8", "SecTimeOut"]

#: Raw verb -> verb group. Other verbs stand for themselves.
VERB_GROUPS = {
    "Calculator Buffer": "Calculator",
    "Open Calculator": "Calculator",
    "Close Calculator": "Calculator",
    "Move Calculator": "Calculator",
    "Clear Scratchwork": "Scratchwork",
    "Scratchwork Draw Mode On": "Scratchwork",
    "Draw": "Scratchwork",
    "Erase": "Scratchwork",
    "Scratchwork Erase Mode On": "Scratchwork",
    "Scratchwork Highlight Mode On": "Scratchwork",
    "Scratchwork Mode Off": "Scratchwork",
    "Scratchwork Mode On": "Scratchwork",
    "Show Timer": "Timer",
    "Hide Timer": "Timer",
    "Vertical Item Scroll": "Scroll",
    "Horizontal Item Scroll": "Scroll",
    "Open Equation Editor": "Equation Editor",
    "Equation Editor Button": "Equation Editor",
    "Close Equation Editor": "Equation Editor",
    "Change Theme": "Theme",
    "Decrease Zoom": "Zoom",
    "Increase Zoom": "Zoom",
    "First Text Change": "Text Change",
    "Last Text Change": "Text Change",
}

#: Seconds a log is cut to, by batch; None keeps everything.
BATCH_LIMITS = {"10": 600, "20": 1200, "30": None}

#: Seconds covered by the dense second grid.
GRID_SECONDS = 1800

#: item -> (kind, accepted answers per slot).
ANSWER_KEY = {
    "VH098810": (CHOICE, [["4"]]),
    "VH098519": (CHOICE, [["2"]]),
    "VH098808": (CHOICE, [["3"]]),
    "VH139047": (MATCH, [["2"], ["3"], ["1"], ["4"]]),
    "VH098759": (CHOICE, [["1"]]),
    "VH098740": (CHOICE, [["4"]]),
    "VH134366": (
        BLANKS,
        [["3.75"], ["5", "5.0", "5.00", "5.000"], ["6.25"], ["7.50", "7.5"], ["8.75"]],
    ),
    "VH098753": (CHOICE, [["4"]]),
    "VH134387": (BLANK, [["60", "X=60", "60 DEGREES"]]),
    "VH098783": (CHOICE, [["2"]]),
    "VH098812": (CHOICE, [["2"]]),
    "VH139196": (
        COMPOSITE,
        [["0.8", ".8", "0.80", ".80"], ["1.4", "1.40"], ["1.10", "1.1"]],
    ),
    "VH134373": (BLANK, [["35", "35C", "C=35", "35 DEGREES CELSIUS"]]),
    "VH098839": (CHOICE, [["4"]]),
    "VH098597": (CHOICE, [["5"]]),
    "VH098556": (CHOICE, [["4"]]),
    "VH098779": (CHOICE, [["4"]]),
    "VH098834": (CHOICE, [["1"]]),
    "VH098522": (CHOICE, [["4"]]),
}

#: Key codes that type something other than their own digit or letter.
KEY_TEXT = {
    "Period": ".",
    "Space": " ",
    "Backslash": "/",
    "Slash": "\\",
    "Enter": "\n",
    "Equal": "=",
    "ArrowRight": ">",
    "ArrowLeft": "<",
    "Minus": "-",
    "Comma": ",",
    "Quote": "'",
    "Backquote": "`",
    "Semicolon": ";",
    "BracketRight": "}",
    "BracketLeft": "{",
}
DELETE_KEYS = ["Backspace", "Delete"]

# --- End of fixed values. -------------------------------------------------------------


def answer_key(
    spark: SparkSession, key: dict[str, tuple[str, list[list[str]]]] | None = None
) -> DataFrame:
    """The answer key as a table (item_id, kind, accepted); one row per item."""
    rows = [(item, kind, accepted) for item, (kind, accepted) in (key or ANSWER_KEY).items()]
    return spark.createDataFrame(rows, KEY_SCHEMA)


def scope(log: DataFrame) -> list[str]:
    """Columns that separate independent logs stacked in one table."""
    return [c for c in ("task", "batch") if c in log.columns]


def subject(log: DataFrame) -> list[str]:
    """Columns that identify one student's time line."""
    return [*scope(log), STUDENT]
