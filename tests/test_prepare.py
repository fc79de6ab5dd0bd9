from __future__ import annotations

from conftest import in_order, rows
from pyspark.sql import functions as F

from logloom.functions.columns import floor_ratio, parse_time, verb_group
from logloom.operators import prepare, timing
from logloom.schema import ATTEMPT, DURATION, ITEM, SEQ, STUDENT, VERB, VERB_RUN

NAV = "Click Progress Navigator"


def attempts(log):
    return in_order(prepare.preprocess(log), ATTEMPT)


def test_going_back_is_a_new_attempt(make_log):
    log = make_log([(1, 0, "A", "Draw"), (1, 1, "A", "Erase"), (1, 2, "B", "Draw"), (1, 3, "A", "Draw")])
    assert attempts(log) == [1, 1, 1, 2]


def test_navigation_between_does_not_end_an_attempt(make_log):
    log = make_log([(1, 0, "A", "Draw"), (1, 1, "B", NAV), (1, 2, "HELPMAT8", "Draw"), (1, 3, "A", "Draw")])
    assert attempts(log) == [1, 1]


def test_no_item_ends_an_attempt_and_has_none(make_log):
    log = make_log([(1, 0, "A", "Draw"), (1, 1, None, "Draw"), (1, 2, "A", "Draw")])
    assert attempts(log) == [1, None, 2]


def test_students_are_apart(make_log):
    log = make_log([(1, 0, "A", "Draw"), (2, 1, "A", "Draw"), (1, 2, "A", "Draw")])
    assert attempts(log) == [1, 1, 1]
    assert in_order(timing.with_verb_duration(log), "verb_duration") == [2.0, 0.0, 0.0]


def test_verb_runs_start_again_in_each_attempt(make_log):
    log = make_log(
        [(1, n, item, verb) for n, (item, verb) in enumerate(
            [("A", "x"), ("A", "x"), ("A", "y"), ("A", None), ("A", None), ("B", None), ("A", "y"), ("A", "x")]
        )]
    )
    # Every missing verb is a run of its own.
    assert in_order(prepare.preprocess(log), VERB_RUN) == [1, 1, 2, 3, 4, 1, 1, 2]


def test_clean_keeps_nulls(make_log):
    log = make_log([(1, 0, None, None), (1, 1, "A", NAV), (1, 2, "BlockRev", "Draw"), (1, 3, "A", None)])
    assert in_order(prepare.base_clean(log), SEQ) == [0, 3]


def test_attempt_numbers_have_no_gaps(make_log):
    log = make_log([(s, n, "AB"[(n // (s + 1)) % 2], "x") for n in range(60) for s in (1, 2)])
    numbered = prepare.preprocess(log)
    found = numbered.groupBy(STUDENT, ITEM).agg(
        F.max(ATTEMPT).alias("high"), F.count_distinct(ATTEMPT).alias("n")
    )
    assert all(r["high"] == r["n"] for r in found.collect())
    assert numbered.count() == log.count()


def test_batches_nest(make_log):
    log = make_log([(1, s, "A", "x") for s in (100, 700, 701, 1300, 5000)])
    found = rows(prepare.cut_to_batches(log), "batch", SEQ)
    assert found == sorted(
        [("10", n) for n in (0, 1)] + [("20", n) for n in (0, 1, 2, 3)] + [("30", n) for n in range(5)]
    )


def test_minute_counts_days_too(make_log):
    log = make_log([(1, 0, "A", "x"), (1, 119, "A", "x"), (1, 86_400 + 60, "A", "x")])
    assert in_order(prepare.with_occurrence(log, "minute", 60), "minute") == [0, 1, 1441]


def test_one_event_lasts_no_time(make_log):
    log = make_log([(1, 5, "A", "x")])
    times = timing.attempt_durations(prepare.preprocess(log))
    assert rows(times, ITEM, ATTEMPT, DURATION) == [("A", 1, 0.0)]
    assert rows(timing.with_zscore(times, ["A"]), "z") == [(None,)]


def test_verb_groups(spark):
    df = spark.createDataFrame([("Erase",), ("Yes",), (None,)], "verb string")
    assert [r[0] for r in df.select(verb_group(F.col("verb"))).collect()] == ["Scratchwork", "Yes", None]


def test_floor_ratio(spark):
    cases = [(7.0, 2.0, 3.0), (0.0, 0.0, 0.0), (1.0, 0.0, float("inf")), (None, 1.0, 0.0), (1.0, None, 0.0)]
    df = spark.createDataFrame(cases, "x double, unit double, expected double")
    assert all(r[0] == r[1] for r in df.select(floor_ratio(F.col("x"), F.col("unit")), "expected").collect())


def test_unreadable_times_are_null(spark):
    df = spark.createDataFrame([("2019-01-02 03:04:05.5",), ("soon",)], "t string")
    assert [r[0] is None for r in df.select(parse_time(F.col("t"))).collect()] == [False, True]


def test_tasks_and_batches_are_apart(make_log):
    log = make_log([(1, n, "ABA"[n], "x") for n in range(3)])
    both = prepare.cut_to_batches(log, {"a": 1, "b": None})
    found = prepare.preprocess(both)
    assert rows(found, "batch", SEQ, ATTEMPT) == [
        ("a", 0, 1), ("a", 1, 1), ("b", 0, 1), ("b", 1, 1), ("b", 2, 2),
    ]
    assert VERB in found.columns
