"""Rebuilds from the log what a student's paper would show, item by item."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.columns import micros_between
from logloom.functions.key import AnswerKey, kind_of, slots_of
from logloom.operators.timeline import along, number_rows, settled
from logloom.schema import (
    ANSWER_KEY,
    BLANK,
    BLANKS,
    CHOICE,
    COMPOSITE,
    DELETE_KEYS,
    INFO,
    ITEM,
    KEY_TEXT,
    LABEL,
    MATCH,
    NO_ANSWER,
    NOT_DONE,
    ORDER,
    TIME,
    VERB,
    subject,
)
from logloom.session import settle

# --- Fixed values: verbs, fields and part names of the log. ---------------------------
ENTER, EXIT = "Enter Item", "Exit Item"
CLICK, PRESS, DROP = "Click Choice", "Math Keypress", "DropChoice"
PART_BLANK = {"A": 0, "B": 1, "C": 2}
PRESS_FIELDS = "code string, numericIdentifier string, partId string"
DROP_FIELDS = "array<struct<source: string, target: string>>"
# --- End of fixed values. -------------------------------------------------------------

VISIT = "visit"
POSITION, DROPS = "position", "drops"
STATUS, SLOTS = "status", "slots"
ANSWERED = "answered"


def in_force(log: DataFrame) -> DataFrame:
    """Give each event the item last entered, whatever item its own row names.

    Before a student enters any item, the first event's item holds.
    """
    entered = F.when(F.col(VERB) == ENTER, F.col(ITEM))
    first = F.struct(*ORDER, ITEM)
    placed = along(log, latest={"_entered": entered}, overall={"_first": (F.min, first)})
    return placed.withColumn(ITEM, F.coalesce("_entered", F.col("_first")[ITEM])).drop(
        "_entered", "_first"
    )


def with_visits(placed: DataFrame) -> DataFrame:
    """Number the visits to an item by its Enter Item events; 0 before the first."""
    entered = F.coalesce((F.col(VERB) == ENTER).cast("int"), F.lit(0))
    return along(
        settled(placed), by=[*subject(placed), ITEM], running={VISIT: entered}
    ).withColumn(VISIT, F.col(VISIT).cast("int"))


def answer_events(log: DataFrame, limits: Mapping[str, int | None] | None = None) -> DataFrame:
    """The few events that answers are made of, with visit and position, written once.

    Those are entering an item, clicks, key presses and drops, and a student's first event at
    each item, which shows that the item was seen. The log is sorted once for all of it. A time
    limit keeps a prefix of a student's log, and no visit depends on what follows it, so the
    batches of `limits` are cut from the same table: each event once per `batch` whose limit it keeps.
    """
    keys = [*subject(log), ITEM]
    entered = F.when(F.col(VERB) == ENTER, F.col(ITEM))
    placed = along(
        log,
        latest={"_entered": entered},
        running={POSITION: F.lit(1)},
        overall={"_first": (F.min, F.struct(*ORDER, ITEM)), "_start": (F.min, F.col(TIME))},
    ).withColumn(ITEM, F.coalesce("_entered", F.col("_first")[ITEM]))
    enters = F.coalesce((F.col(VERB) == ENTER).cast("int"), F.lit(0))
    numbered = along(settled(placed), by=keys, running={VISIT: enters, "_nth": F.lit(1)})
    needed = (F.col("_nth") == 1) | F.coalesce(F.col(VERB).isin(ENTER, CLICK, PRESS, DROP), F.lit(False))
    drops = F.when(F.col(VERB) == DROP, F.from_json(INFO, DROP_FIELDS))
    kept = settle(
        numbered.where(needed).select(
            *subject(log),
            *ORDER,
            ITEM,
            VERB,
            INFO,
            F.col(VISIT).cast("int").alias(VISIT),
            F.col(POSITION).cast("long").alias(POSITION),
            drops.alias(DROPS),
            micros_between(F.col("_start"), F.col(TIME)).alias("_elapsed"),
        )
    )
    if limits is None:
        return kept.drop("_elapsed")
    within = [
        F.lit(batch) if limit is None else F.when(F.col("_elapsed") <= limit * 1_000_000, F.lit(batch))
        for batch, limit in limits.items()
    ]
    return kept.withColumn("batch", F.explode(F.array_compact(F.array(*within)))).drop("_elapsed")


def visit_events(visits: DataFrame) -> DataFrame:
    """What happened inside visits: no Enter, no Exit, nothing before the first Enter."""
    inside = ~F.coalesce(F.col(VERB).isin(ENTER, EXIT), F.lit(False))
    return visits.where((F.col(VISIT) > 0) & inside)


def last_option() -> Column:
    """Aggregate: the option clicked last inside a visit, as a list of one."""
    option = F.right(F.split_part(INFO, F.lit(":"), F.lit(1)), F.lit(1)).try_cast("int")
    clicked = F.when((F.col(VISIT) > 0) & (F.col(VERB) == CLICK), option)
    last = F.max_by(clicked, F.when(clicked.isNotNull(), F.struct(*ORDER)))
    return F.when(last.isNotNull(), F.array(last.cast("string")))


def last_targets(slots: int, parsed: Column | None = None) -> Column:
    """Aggregate: the target dropped last for each source inside visits; null where none.

    `parsed` is the list of drops of an event, if there is a column of it.
    """
    inside = (F.col(VISIT) > 0) & (F.col(VERB) == DROP)
    drops = F.when(inside, F.from_json(INFO, DROP_FIELDS) if parsed is None else parsed)

    def target(slot: int) -> Column:
        source = str(slot + 1)
        own = F.filter(drops, lambda d: d["source"] == source)
        found = F.try_element_at(own, F.lit(-1))["target"]
        return F.max_by(found, F.when(found.isNotNull(), F.struct(*ORDER)))

    targets = [target(n) for n in range(slots)]
    return F.when(F.coalesce(*targets).isNotNull(), F.array(*targets))


def choice_answers(visits: DataFrame) -> DataFrame:
    """Single-choice answers of every student and item that has one."""
    clicks = visits.where(F.col(VERB) == CLICK)
    found = clicks.groupBy(*subject(visits), ITEM).agg(last_option().alias(SLOTS))
    return found.where(F.col(SLOTS).isNotNull())


def match_answers(visits: DataFrame, slots: int = 4) -> DataFrame:
    """Match answers, lists by source, of every student and item that has one."""
    drops = visits.where(F.col(VERB) == DROP)
    found = drops.groupBy(*subject(visits), ITEM).agg(last_targets(slots).alias(SLOTS))
    return found.where(F.col(SLOTS).isNotNull())


def typed_text(code: Column, key_text: Mapping[str, str] = KEY_TEXT) -> Column:
    """The text a key code adds; null for keys that add none."""
    pairs = [F.lit(x) for pair in key_text.items() for x in pair]
    named = F.regexp_extract(code, "^(?:Digit|Key)(.+)$", 1)
    return F.coalesce(F.create_map(*pairs)[code], F.when(named != "", named))


# A blank's keystrokes are a list of edits: "+text" appends, "-n" deletes the last n characters,
# "~" strips newlines at the end, as leaving a visit does. Any stretch of edits reduces to
# the edits that reach the text before it plus the text it leaves, again as edits, so
# stretches can be reduced apart, in order, and their results reduced together.


def reduce_edits(edits: Column) -> Column:
    """The shortest list of edits with the same effect on any text before it."""

    def state(reach: Column, deletes: Column, text: Column) -> Column:
        """Edits of the text before, deletions of it after those, and own text."""
        return F.struct(reach.alias("reach"), deletes.alias("deletes"), text.alias("text"))

    def apart(reach: Column, deletes: Column) -> Column:
        deletion = F.concat(F.lit("-"), deletes.cast("string"))
        return F.when(deletes > 0, F.concat(reach, F.array(deletion))).otherwise(reach)

    def step(before: Column, edit: Column) -> Column:
        reach, deletes, text = before["reach"], before["deletes"], before["text"]
        kind, rest = F.left(edit, F.lit(1)), F.substring(edit, F.lit(2), F.length(edit))
        kept = F.length(text) - rest.try_cast("long")
        shorter = F.left(text, F.greatest(kept, F.lit(0)).cast("int"))
        deleted = state(reach, deletes + F.greatest(-kept, F.lit(0)), shorter)
        stripped = F.regexp_replace(text, "\n+$", "")
        # Stripping twice in a row is stripping once.
        again = (deletes == 0) & (F.size(reach) > 0)
        through = F.when(again, reach).otherwise(
            F.concat(apart(reach, deletes), F.array(F.lit("~")))
        )
        left = F.when(stripped != "", state(reach, deletes, stripped)).otherwise(
            state(through, F.lit(0).cast("long"), F.lit(""))
        )
        return (
            F.when(kind == "+", state(reach, deletes, F.concat(text, rest)))
            .when(kind == "-", deleted)
            .otherwise(left)
        )

    start = state(F.array().cast("array<string>"), F.lit(0).cast("long"), F.lit(""))

    def finish(end: Column) -> Column:
        text = F.array(F.concat(F.lit("+"), end["text"]))
        return F.concat(apart(end["reach"], end["deletes"]), text)

    return F.aggregate(edits, start, step, finish)


def _reduce_neighbours(edits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(*order, "edits")))
    gathered = edits.groupBy(*keys).agg(rows.alias("_rows"))
    return gathered.select(
        *keys, reduce_edits(F.flatten(F.col("_rows.edits"))).alias("edits")
    )


def reduced(edits: DataFrame, keys: list[str], size: int = 1000) -> DataFrame:
    """Reduce the edits of each key, ordered by (round, place), to one list.

    Two steps gather at most `size` neighbours each, so no task folds a long log alone;
    the last gathers what they left.
    """
    for _ in range(2):
        blocks = edits.withColumn("_block", F.floor(F.col("place") / size).cast("long"))
        edits = _reduce_neighbours(
            blocks, [*keys, "round", "_block"], ["place"]
        ).withColumnRenamed("_block", "place")
    return _reduce_neighbours(edits, keys, ["round", "place"])


def keystroke_edits(
    visits: DataFrame,
    key: AnswerKey = ANSWER_KEY,
    legacy: bool = False,
    key_text: Mapping[str, str] = KEY_TEXT,
) -> DataFrame:
    """Rows (student, item, blank, round, place, edits) of all typing into fill-in items."""
    keys = [*subject(visits), ITEM]
    kind, blanks = kind_of(F.col(ITEM), key), slots_of(F.col(ITEM), key)
    press = F.from_json(INFO, PRESS_FIELDS)
    parts = F.create_map(*[F.lit(x) for pair in PART_BLANK.items() for x in pair])
    typed = typed_text(F.col("_press.code"), key_text)
    if legacy:
        typed = F.when(F.col("_press.code") != "KeyK", typed)
    placed = visits if POSITION in visits.columns else number_rows(settled(visits), name=POSITION)
    typing = (
        placed
        .where((F.col(VISIT) > 0) & F.col(VERB).isin(ENTER, PRESS))
        .where(kind.isin(BLANK, BLANKS, COMPOSITE))
        .withColumns({"_kind": kind, "_blanks": blanks, "_press": press})
        .withColumn(
            "_edit",
            F.when(F.col(VERB) == ENTER, F.lit("~"))
            .when(F.col("_press.code").isin(*DELETE_KEYS), F.lit("-1"))
            .otherwise(F.concat(F.lit("+"), typed)),
        )
        .where(F.col("_edit").isNotNull())
        .withColumn(
            "_blank",
            F.when(F.col("_kind") == BLANK, F.lit(0))
            .when(F.col("_kind") == BLANKS, F.col("_press.numericIdentifier").try_cast("int") - 1)
            .otherwise(parts[F.col("_press.partId")]),
        )
    )
    if legacy:
        # Single blanks replay the last visit first, then the visits from the second on.
        last = visits.groupBy(*keys).agg(F.max(VISIT).alias("_last"))
        single = F.col("_kind") == BLANK
        replayed = F.when(single & (F.col(VISIT) == F.col("_last")), F.lit(0))
        regular = F.when(~single | (F.col(VISIT) > 1), F.lit(1))
        typing = typing.join(last, keys).withColumn(
            "round", F.explode(F.array_compact(F.array(replayed, regular)))
        )
    else:
        typing = typing.withColumn("round", F.lit(0))
    every = F.sequence(F.lit(0), F.col("_blanks") - 1)
    own = F.when(F.col("_blank").between(0, F.col("_blanks") - 1), F.array("_blank"))
    return typing.withColumn(
        "blank", F.explode(F.when(F.col(VERB) == ENTER, every).otherwise(own))
    ).select(*keys, "blank", "round", F.col(POSITION).alias("place"), F.array("_edit").alias("edits"))


def blank_answers(
    visits: DataFrame,
    key: AnswerKey = ANSWER_KEY,
    legacy: bool = False,
    key_text: Mapping[str, str] = KEY_TEXT,
) -> DataFrame:
    """The text in every blank of the fill-in items, as a list by blank.

    Text stays from visit to visit. `legacy` replays single-blank items in another order:
    the last visit first, then the visits from the second on; and the letter K is lost.
    """
    keys = [*subject(visits), ITEM]
    edits = reduced(keystroke_edits(visits, key, legacy, key_text), [*keys, "blank"])
    kept = F.element_at("edits", -1)
    text = F.trim(F.substring(kept, F.lit(2), F.length(kept)), F.lit("\n"))
    by_blank = F.array_sort(F.collect_list(F.struct("blank", text.alias("text"))))
    return (
        edits.groupBy(*keys)
        .agg(by_blank.alias("_texts"))
        .select(*keys, F.col("_texts.text").alias(SLOTS))
    )


def responses(
    log: DataFrame,
    roster: DataFrame,
    key: AnswerKey = ANSWER_KEY,
    legacy: bool = False,
    limits: Mapping[str, int | None] | None = None,
) -> DataFrame:
    """One row per student on the roster and item of the key.

    The roster has the log's task and batch columns, if it has any. With `limits`, the log is
    whole and the answers are those of each batch's time limit in seconds. status is "answered", "N_A" (seen without an answer) or "N_D" (never seen); slots holds
    the answer's parts.
    """
    visits = answer_events(log, limits)
    keys = [*subject(visits), ITEM]
    kind = kind_of(F.col(ITEM), key)
    matches = [len(accepted) for k, accepted in key.values() if k == MATCH]
    # One pass finds who saw which item, and all answers that one event decides.
    seen = (
        visits.where(kind.isNotNull())
        .groupBy(*keys)
        .agg(last_option().alias("_option"), last_targets(max(matches, default=1), F.col(DROPS)).alias("_targets"))
    )
    typed = blank_answers(visits, key, legacy).withColumnRenamed(SLOTS, "_texts")
    # A single blank without text is no answer; several blanks always are one.
    nothing = F.array_repeat(F.lit(""), slots_of(F.col(ITEM), key))
    slots = (
        F.when(kind == CHOICE, F.col("_option"))
        .when(kind == MATCH, F.col("_targets"))
        .when(kind == BLANK, F.when(F.col("_texts")[0] != "", F.col("_texts")))
        .otherwise(F.coalesce("_texts", nothing))
    )
    given = seen.join(typed, keys, "left").select(
        *keys, slots.alias(SLOTS), F.lit(True).alias("_seen")
    )
    expected = roster.withColumn(ITEM, F.explode(F.array(*[F.lit(i) for i in key])))
    status = (
        F.when(F.col(SLOTS).isNotNull(), F.lit(ANSWERED))
        .when(F.col("_seen"), F.lit(NO_ANSWER))
        .otherwise(F.lit(NOT_DONE))
    )
    return expected.join(given, keys, "left").withColumn(STATUS, status).drop("_seen")


def answer_text(key: AnswerKey = ANSWER_KEY) -> Column:
    """The answer as text: the only slot, or the slots as a JSON list; else the status."""
    single = kind_of(F.col(ITEM), key).isin(CHOICE, BLANK)
    given = F.when(single, F.col(SLOTS)[0]).otherwise(F.to_json(SLOTS))
    return F.when(F.col(STATUS) == ANSWERED, given).otherwise(F.col(STATUS))


def matrix(long: DataFrame, value: Column, items: Sequence[str]) -> DataFrame:
    """One row per student and one column per item."""
    extra = [c for c in (LABEL,) if c in long.columns]
    return (
        long.withColumn("_value", value)
        .groupBy(*subject(long), *extra)
        .pivot(ITEM, list(items))
        .agg(F.first("_value"))
    )


def response_matrix(answers: DataFrame, key: AnswerKey = ANSWER_KEY) -> DataFrame:
    return matrix(answers, answer_text(key), list(key))
