from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logloom.operators import series
from logloom.operators.clean import clean_log
from logloom.operators.timeline import cut
from logloom.schema import ITEM, SEQ, STUDENT, VERB
from logloom.session import settle


@pytest.mark.parametrize(
    ("verb", "info", "expected"),
    [
        ("Click Choice", "VH098759_1:checked", "1"),
        ("Click Choice", "nothing", ""),
        ("Eliminate Choice", "VH098759_2:eliminated", "2:eliminated"),
        ("DropChoice", '[{"source":"1","target":2},{"source":"2","target":1}]', "2"),
        ("DropChoice", None, ""),
        ("Horizontal Item Scroll", "12,36,0", "12_36"),
        ("Vertical Item Scroll", ",36,0", "_36"),
        ("Vertical Item Scroll", "12,,0", "12_"),
        ("Vertical Item Scroll", "abc", ""),
        ("Vertical Item Scroll", "12,36", ""),
        ("Vertical Item Scroll", "a,b,c", ""),
        ("Math Keypress", '{"code":"Digit1"}', ""),
        ("Yes", "on", ""),
        ("Draw", "on", "on"),
        ("Draw", None, ""),
    ],
)
def test_clean_info(make_log, verb, info, expected):
    log = make_log([(1, 0, "A", verb, info)])
    assert clean_log(log).select(VERB).first()[0] == f"{verb}_{expected}"


def test_events_without_time_are_dropped(make_log):
    assert rows(clean_log(make_log([(1, None, "A", "x"), (1, 1, "A", "x")])), SEQ) == [(1,)]


def test_bins_and_durations(make_log):
    log = make_log([(1, 0, "A", "x"), (1, 5, "A", "x"), (1, 23, "A", "x"), (2, 3, "A", "x")])
    found = series.second_bins(clean_log(log), time_bin=2, limit=20)
    # The event after the limit is dropped, but still ends the one before it.
    assert rows(found, STUDENT, "occur_second", "verb_duration") == [(1, 0, 2.5), (1, 2, 9.0), (2, 0, 0.0)]


def test_last_value_per_second_and_column(make_log):
    log = make_log([(1, 0, "A", "x"), (1, 0, None, "y"), (1, 1, "B", None)])
    last = series.last_per_second(series.second_bins(clean_log(log)))
    assert rows(last, "occur_second", ITEM, VERB) == [(0, "A", "y_"), (1, "B", None)]


def test_fill_and_mask(make_log):
    log = make_log([(1, 0, "A", "x"), (1, 3, "B", "y"), (2, 0, None, "z"), (2, 1, "C", "z")])
    dense = series.dense_rows(series.second_series(log, limit=5))
    assert dense.count() == 12
    one = rows(dense.where(F.col(STUDENT) == 1), "occur_second", ITEM, VERB, "verb_duration")
    assert one == [
        (0, "A", "x_", 3.0), (1, "A", "x_", 3.0), (2, "A", "x_", 3.0), (3, "B", "y_", 0.0), (4, "0", "0", 0.0), (5, "0", "0", 0.0),
    ]
    # Nothing is carried from one student to the next.
    assert rows(dense.where((F.col(STUDENT) == 2) & (F.col("occur_second") == 0)), ITEM) == [(None,)]


def test_arrays_wide_and_stacked(make_log):
    spans = series.second_series(make_log([(1, 0, "A", "x"), (1, 2, "B", "y")]), limit=3)
    arrays = series.series_arrays(spans, [ITEM, VERB])
    assert arrays.first()[ITEM] == ["A", "A", "B", "0"]
    wide = series.wide_series(spans, ITEM, 3).first()
    assert [wide[str(n)] for n in range(4)] == ["A", "A", "B", "0"]
    frames = {c: arrays.select(STUDENT, c) for c in (ITEM, VERB)}
    stack = series.stacked(frames).first()["series"]
    assert [(s[ITEM], s[VERB]) for s in stack] == [("A", "x_"), ("A", "x_"), ("B", "y_"), ("0", "0")]
    frames[VERB] = arrays.select(STUDENT, F.slice(VERB, 1, 2).alias(VERB))
    with pytest.raises(Exception, match="differ in length"):
        series.stacked(frames).collect()


def test_arrays_are_stacked_without_broadcasts(spark):
    """Two thousand students' grids are a few kilobytes in a file and many times that as rows."""
    spans = spark.range(2000).select(
        F.col("id").alias(STUDENT), F.lit(0).alias("start"), F.lit(1800).alias("end"), F.lit("A").alias(ITEM), F.lit("x").alias(VERB)
    )
    arrays = settle(series.series_arrays(spans, [ITEM, VERB]))
    stack = series.stacked({c: arrays.select(STUDENT, c) for c in (ITEM, VERB)})
    plan = stack._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert stack.where(F.size("series") == 1801).count() == 2000


@pytest.mark.parametrize("max_rows", [1000, 4])
def test_spans_come_from_the_sort_of_the_bins(make_log, max_rows):
    """Values, also null ones and those of a cut log, are those of the last events of bins, at one sort."""
    log = make_log(
        [(1, 0, None, "x"), (1, 0, "A", None), (1, 0, None, "y"), (1, 2, None, "z"), (1, 2, "B", "z"), (1, 4, "C", "w"), (1, 90, "D", "w")]
        + [(2, 1, "A", "x"), (2, 5, None, None), (3, 0, None, None)]
    )
    bins = series.second_bins(clean_log(cut(log, max_rows)), 1, 5)
    found = series.spans_of_bins(series.filled_bins(bins), 1, 5)
    assert rows(found) == rows(series.series_spans(series.last_per_second(bins), 1, 5), *found.columns)
    if max_rows == 1000:
        plan = series.second_series(log, 1, 5)._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[-1].count("Exchange") == 1 and "Aggregate" not in plan
