"""A log cut into slices gives the same results as a whole one."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logloom.operators import answers, behaviour, prepare, series, timing
from logloom.operators.clean import clean_log
from logloom.operators.encode import code_book
from logloom.operators.timeline import SLICE, along, cut, in_blocks, is_cut, number_rows
from logloom.plans.folds import stratified_folds
from logloom.plans.metrics import rank_auc
from logloom.schema import ATTEMPT, ITEM, SEQ, STUDENT, TIME, VERB, VERB_RUN
from logloom.sources.nested import student_logs

KEY = {
    "A": ("blank", [["12"]]),
    "B": ("blanks", [["1"], ["2"]]),
    "C": ("choice", [["3"]]),
    "D": ("match", [["1"], ["2"], ["3"], ["4"]]),
}


def random_rows(seed: int = 3, events: int = 400):
    """Student 1 has more than a third of all events; items come in long and short stays."""
    draw = random.Random(seed)
    codes = ["Digit1", "Digit2", "Backspace", "Enter", "KeyA", "Period", "Tab"]
    found, item = [], "A"
    for n in range(events):
        student = 1 if draw.random() < 0.4 else draw.randint(2, 8)
        if draw.random() < 0.3:
            item = draw.choice(["A", "B", "C", "D", None])
        verb = draw.choice(
            ["Enter Item", "Exit Item", "Math Keypress", "Math Keypress", "Click Choice", "DropChoice", "Draw", None]
        )
        info = {
            "Math Keypress": '{"code":"%s","numericIdentifier":"%d"}'
            % (draw.choice(codes), draw.randint(1, 2)),
            "Click Choice": f"C_{draw.randint(1, 4)}:checked",
            "DropChoice": '[{"source":"%d","target":%d}]' % (draw.randint(1, 4), draw.randint(1, 4)),
        }.get(verb)
        found.append((student, n // 3, item, verb, info))
    return found


@pytest.fixture(scope="module")
def whole(make_log):
    return make_log(random_rows()).cache()


@pytest.fixture(scope="module", params=[20, 60])
def sliced(whole, request):
    """All students in slices, and only the first one."""
    return cut(whole, max_rows=request.param)


def test_cut_only_where_needed(whole, sliced):
    assert not is_cut(cut(whole, max_rows=10_000))
    assert is_cut(sliced)
    counts = dict(rows(whole.groupBy(STUDENT).count()))
    hot = {r[0] for r in sliced.where(F.col(SLICE) > 0).select(STUDENT).distinct().collect()}
    others = {r[0] for r in sliced.where(F.col(SLICE) == 0).select(STUDENT).distinct().collect()}
    assert 1 in hot and not hot & others and hot | others == set(counts)
    assert not others or max(counts[s] for s in others) <= 60 < counts[1]
    sizes = [r[0] for r in sliced.where(F.col(SLICE) > 0).groupBy(SLICE).count().select("count").collect()]
    assert len(sizes) > 1 and max(sizes) < 1.8 * sum(sizes) / len(sizes)
    assert rows(sliced.drop(SLICE)) == rows(whole)


def test_a_column_of_the_users_named_slice(whole):
    named = whole.withColumn("slice", F.lit("mine"))
    assert not is_cut(named)
    placed = number_rows(cut(named, max_rows=20))
    assert rows(placed.select("slice").distinct()) == [("mine",)] and placed.count() == whole.count()


def test_slices_follow_time(sliced):
    order = sliced.where(F.col(STUDENT) == 1).orderBy(TIME, SEQ).collect()
    numbers = [r[SLICE] for r in order]
    assert numbers == sorted(numbers) and len(set(numbers)) > 1


def test_every_kind_of_column(whole, sliced):
    def columns(log):
        number = F.col(SEQ) % 7
        return along(
            log,
            previous={"before": F.col(VERB)},
            following={"after": F.col(VERB)},
            running={"total": number, "some": F.when(number > 4, number)},
            latest={"last": F.when(F.col(VERB) == "Draw", F.col(ITEM))},
            overall={"first": (F.min, F.col(TIME)), "high": (F.max, F.col(SEQ))},
        )

    names = [STUDENT, SEQ, "before", "after", "total", "some", "last", "first", "high"]
    assert rows(columns(whole), *names) == rows(columns(sliced), *names)


OPERATORS = {
    "attempts": lambda log: prepare.preprocess(log).select(STUDENT, SEQ, ATTEMPT, VERB_RUN),
    "elapsed": lambda log: prepare.with_elapsed(log).select(SEQ, "elapsed_micros"),
    "batches": lambda log: prepare.cut_to_batches(log, {"a": 60, "b": None}).select(SEQ, "batch"),
    "verb_duration": lambda log: timing.with_verb_duration(log).select(SEQ, "verb_duration"),
    "time_features": lambda log: timing.time_features(log, ["A", "B", "C", "D"]).select(
        STUDENT, "feature", F.round("value", 6)
    ),
    "chains": lambda log: behaviour.behaviour_features(log, support=2, least=2),
    "tokens": lambda log: behaviour.verb_time_tokens(prepare.preprocess(log)).select(
        STUDENT, "position", "token"
    ),
    "minutes": lambda log: behaviour.minute_series(
        behaviour.minute_summary(behaviour.minute_events(log, 10))
    ),
    "bins": lambda log: series.second_bins(clean_log(log), 1, 100).select(
        SEQ, "occur_second", "verb_duration"
    ),
    "dense": lambda log: series.dense_rows(series.second_series(log, 1, 140)),
    "in_force": lambda log: answers.in_force(log).select(SEQ, ITEM),
    "visits": lambda log: answers.with_visits(answers.in_force(log)).select(SEQ, "visit"),
    "responses": lambda log: answers.responses(
        log, log.select(STUDENT).distinct(), KEY
    ).select(STUDENT, ITEM, "status", F.to_json("slots")),
    "documents": lambda log: student_logs(answers.in_force(log), size=9).select(
        STUDENT, ITEM, "block", F.to_json(F.struct("events"))
    ),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_same_results(name, whole, sliced):
    expected = rows(OPERATORS[name](whole))
    assert expected
    assert rows(OPERATORS[name](sliced)) == expected


def test_order_of_input_rows_changes_nothing(whole):
    shuffled = whole.orderBy(F.rand(5))
    for name in ("attempts", "tokens", "responses"):
        assert rows(OPERATORS[name](shuffled)) == rows(OPERATORS[name](whole))


def test_blocks_are_bounded_and_whole(whole):
    numbered = number_rows(whole)
    blocks = in_blocks(numbered, [STUDENT], F.col(SEQ), size=7)
    assert blocks.agg(F.max(F.size("values"))).first()[0] == 7
    again = blocks.select(STUDENT, "block", F.posexplode("values").alias("n", SEQ))
    assert rows(again.select(STUDENT, (F.col("block") * 7 + F.col("n")).alias("position"), SEQ)) == rows(
        numbered, STUDENT, "position", SEQ
    )


def test_code_book_and_folds_and_auc_in_slices(spark, whole):
    words = spark.range(300).select(F.md5(F.col("id").cast("string")).alias("word"))
    assert rows(code_book(words, "word", max_rows=25)) == rows(code_book(words, "word"))
    assert [r[1] for r in rows(code_book(words, "word"))] == list(range(300))
    people = spark.range(200).select(F.col("id").alias(STUDENT), (F.col("id") % 3 == 0).alias("label"))
    for seed in (None, 4):
        assert rows(stratified_folds(people, 3, seed, max_rows=15)) == rows(
            stratified_folds(people, 3, seed)
        )
    guesses = spark.range(300).selectExpr(
        "id % 2 AS fold", "(id * 37 % 101) / 100D AS probability_true", "CAST(id * 7 % 5 < 2 AS INT) AS truth"
    )
    assert rows(rank_auc(guesses, ["fold"], max_rows=20)) == rows(rank_auc(guesses, ["fold"]))
