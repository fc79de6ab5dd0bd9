from __future__ import annotations

import random
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logloom.operators import prepare, timing
from logloom.schema import ATTEMPT, DURATION, ITEM, STUDENT
from logloom.session import settle


@pytest.fixture(scope="module")
def times(spark):
    return spark.createDataFrame(
        [(1, "A", 1, 10.0), (1, "A", 2, 20.0), (1, "B", 1, 5.0), (2, "A", 1, 30.0), (2, "B", 1, 5.0), (3, "P", 1, 9.0)],
        f"{STUDENT} long, {ITEM} string, {ATTEMPT} int, {DURATION} double",
    )


def test_equal_times_have_no_z_and_are_not_valid(times):
    scores = timing.with_zscore(times, ["A", "B"])
    assert rows(scores.where(F.col(ITEM) == "B"), "z") == [(None,), (None,)]
    stats = {r[STUDENT]: r for r in timing.student_time_stats(scores, ["A", "B"]).collect()}
    assert stats[1]["valid_question_attempt_percent"] == 0.5
    assert 3 not in stats


def test_student_stats(times):
    stats = {r[STUDENT]: r for r in timing.student_time_stats(timing.with_zscore(times, ["A", "B"]), ["A", "B"]).collect()}
    mean, dev = statistics.mean([10, 20, 30]), statistics.stdev([10, 20, 30])
    z = [(10 - mean) / dev, (20 - mean) / dev]
    one = stats[1]
    assert one["question_attempt_mean_time"] == pytest.approx(35 / 3)
    assert one["question_attempt_std_time"] == pytest.approx(statistics.stdev([10, 20, 5]))
    assert one["scaled_question_attempt_mean_time"] == pytest.approx(statistics.mean(z))
    assert one["scaled_question_attempt_std_time"] == pytest.approx(statistics.pstdev(z))


def test_short_attempts_are_not_valid(spark):
    rows_ = [(s, "A", 1, 100.0) for s in range(1, 20)] + [(20, "A", 1, 1.0)]
    df = spark.createDataFrame(rows_, f"{STUDENT} long, {ITEM} string, {ATTEMPT} int, {DURATION} double")
    stats = timing.student_time_stats(timing.with_zscore(df, ["A"]), ["A"])
    assert rows(stats.where(F.col(STUDENT) > 18), STUDENT, "valid_question_attempt_percent") == [(19, 1.0), (20, 0.0)]


def test_item_stats(times):
    found = rows(timing.item_attempt_stats(times).where(F.col(STUDENT) == 1))
    assert found == [(1, "A", 2, 15.0, 10.0), (1, "B", 1, 5.0, 5.0)]


def test_wide_features(make_log):
    log = make_log([(1, 0, "A", "x"), (1, 4, "A", "x"), (1, 5, "B", "x"), (2, 0, "Other", "x"), (2, 3, "Other", "x")])
    wide = timing.widen(timing.time_features(log, ["A", "B"]))
    one, two = wide.orderBy(STUDENT).collect()
    assert one["x_A_1"] == 4.0 and one["x_B_1"] == 0.0 and one["x_Other_1"] == 0.0
    assert two["x_A_1"] == 0.0 and two["y_attempt_times_Other"] == 1.0
    # A student without attempts at listed items has no value there, and not 0.
    assert two["z_question_attempt_mean_time"] is None
    assert one["z_question_attempt_mean_time"] == 2.0


def test_too_many_columns_are_an_error(spark, times):
    long = times.select(STUDENT, F.concat(ITEM, F.col(STUDENT)).alias("feature"), F.lit(1.0).alias("value"))
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    try:
        with pytest.raises(ValueError, match="more than 3"):
            timing.feature_names(long)
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_durations_stop_at_another_item(make_log):
    log = make_log([(1, 0, "A", "x"), (1, 3, "A", "y"), (1, 9, "B", "x"), (1, 9, None, "x"), (1, 10, None, "x")])
    timed = timing.with_verb_duration(log).orderBy("seq")
    assert [r["verb_duration"] for r in timed.collect()] == [3.0, 0.0, 0.0, 0.0, 0.0]


def test_levels(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (1, "a", 10.0), (1, "b", 4.0)], "student_id long, k string, verb_duration double")
    by_group = timing.with_duration_level(df, by=["k"]).orderBy("verb_duration")
    assert [r["duration_level"] for r in by_group.collect()] == [0.0, 0.0, 14.0]
    unit = statistics.stdev([0, 10, 4]) / 2000
    over_all = timing.with_duration_level(df).orderBy("verb_duration")
    assert [r["duration_level"] for r in over_all.collect()] == [0.0, 4 // unit, 10 // unit]


def test_fitted_stats_score_another_log(times):
    fitted = timing.item_duration_stats(times, ["A"])
    other = times.where(F.col(STUDENT) == 2)
    assert rows(timing.with_zscore(other, ["A"], fitted), "z") == [(1.0,)]
    assert prepare.real_items(other, ["A"]).count() == 1


def test_states_of_parts_merge_to_the_whole(spark, make_log):
    rng = random.Random(3)
    log = make_log([(s, rng.randrange(5000), rng.choice("ABC"), "x") for s in range(30) for _ in range(12)] + [(90, 1, "Z", "x")])
    durations = settle(timing.attempt_durations(prepare.preprocess(log)))
    items = ["A", "B", "C", "Z"]
    parts = [timing.item_duration_state(durations.where(F.col(STUDENT) % 5 == k), items) for k in range(5)]
    merged = timing.merged_states(timing.merged_states(*parts[:2]), timing.merged_states(*parts[2:]), parts[0].where("false"))
    whole = {r[ITEM]: r for r in timing.item_duration_stats(durations, items).collect()}
    found = {r[ITEM]: r for r in timing.stats_of_state(merged).collect()}
    assert found.keys() == whole.keys() == set(items)
    for item, r in whole.items():
        assert found[item]["item_mean"] == pytest.approx(r["item_mean"])
        assert found[item]["item_std"] == (None if r["item_std"] is None else pytest.approx(r["item_std"]))
