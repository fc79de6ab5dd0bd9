from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logloom.operators import answers, scoring
from logloom.schema import ANSWER_KEY, ITEM, KEY_TEXT, NO_ANSWER, NOT_DONE, STUDENT, answer_key

KEY = {
    "A": ("blank", [["1.X", "12"]]),
    "B": ("blanks", [["1"], ["2", "2.0"]]),
    "C": ("choice", [["3"]]),
    "D": ("match", [["2"], ["3"], ["1"], ["4"]]),
    "E": ("composite", [["1"], ["2"], ["3"]]),
}


def press(code: str, number: int = 1, part: str = "A") -> str:
    return '{"code":"%s","numericIdentifier":"%d","partId":"%s"}' % (code, number, part)


def visit(item: str, *codes, student: int = 1):
    """An Enter and key presses; a code may be (code, blank number, part)."""
    found = [(item, "Enter Item", None)]
    for code in codes:
        parts = (code,) if isinstance(code, str) else code
        found.append((item, "Math Keypress", press(*parts)))
    return [(student, *event) for event in found]


def log_of(make_log, *visits):
    events = [e for v in visits for e in v]
    return make_log([(s, n, item, verb, info) for n, (s, item, verb, info) in enumerate(events)])


def answer(make_log, *visits, item="A", legacy=False, key=KEY):
    log = log_of(make_log, *visits)
    found = answers.responses(log, log.select(STUDENT).distinct(), key, legacy)
    row = found.where(F.col(ITEM) == item).first()
    return row["slots"] if row["status"] == answers.ANSWERED else row["status"]


def test_keys(make_log):
    assert answer(make_log, visit("A", "Digit1", "Digit2", "Backspace", "Period", "KeyX")) == ["1.X"]
    assert answer(make_log, visit("A", "Backspace", "Digit5")) == ["5"]
    typed = visit("A", "Backslash", "Slash", "Space", "ShiftLeft", "F5", "", "Minus", "BracketLeft")
    assert answer(make_log, typed) == ["/\\ -{"]


def test_text_stays_between_visits(make_log):
    first, second = visit("A", "Digit1"), visit("A", "Digit2")
    assert answer(make_log, first, second) == ["12"]
    assert answer(make_log, first, second, legacy=True) == ["22"]
    assert answer(make_log, first, legacy=True) == ["1"]


def test_letter_k(make_log):
    assert answer(make_log, visit("A", "KeyK", "Digit1")) == ["K1"]
    assert answer(make_log, visit("A", "KeyK", "Digit1"), legacy=True) == ["1"]


def test_newlines_are_stripped_after_each_visit(make_log):
    assert answer(make_log, visit("A", "Enter", "Digit1", "Enter", "Digit2", "Enter")) == ["1\n2"]
    # The newline is gone before the second visit, so Backspace takes the 1.
    assert answer(make_log, visit("A", "Digit1", "Enter"), visit("A", "Backspace", "Digit2")) == ["2"]


def test_nothing_typed(make_log):
    assert answer(make_log, visit("A")) == NO_ANSWER
    assert answer(make_log, visit("A", "Digit1", "Backspace")) == NO_ANSWER
    assert answer(make_log, visit("A"), item="B") == NOT_DONE
    assert answer(make_log, visit("B"), item="B") == ["", ""]


def test_before_the_first_enter(make_log):
    events = [(1, "A", "Math Keypress", press("Digit1")), (1, "B", "Draw", None), (1, "B", "Enter Item", None)]
    assert answer(make_log, events, item="A") == NO_ANSWER
    assert answer(make_log, events, item="B") == ["", ""]
    leading = [(1, "B", "Draw", None)]
    assert answer(make_log, leading, item="B") == ["", ""]


def test_item_entered_holds_whatever_the_row_says(make_log):
    events = [(1, "C", "Enter Item", None), (1, "A", "Click Choice", "C_2:checked"), (1, "A", "Enter Item", None)]
    assert answer(make_log, events, item="C") == ["2"]


def test_blanks_are_routed(make_log):
    typed = visit("B", ("Digit1", 1), ("Digit2", 2), ("Digit3", 1), ("Digit9", 7))
    assert answer(make_log, typed, item="B") == ["13", "2"]
    parts = visit("E", ("Digit1", 1, "A"), ("Digit3", 1, "C"))
    assert answer(make_log, parts, item="E") == ["1", "", "3"]


def test_choice_is_the_last_one_of_any_visit(make_log):
    def click(n):
        return (1, "C", "Click Choice", f"C_{n}:checked")

    assert answer(make_log, visit("C") + [click(1), click(4)], visit("C"), item="C") == ["4"]
    assert answer(make_log, visit("C"), item="C") == NO_ANSWER


def test_match_takes_the_last_target(make_log):
    def drop(*pairs):
        text = ",".join('{"source":"%d","target":%d}' % p for p in pairs)
        return (1, "D", "DropChoice", f"[{text}]")

    assert answer(make_log, visit("D") + [drop((1, 2), (3, 4)), drop((1, 3))], item="D") == ["3", None, "4", None]
    assert answer(make_log, visit("D"), item="D") == NO_ANSWER


def replay(visits: list[list[str]]) -> str:
    """What the keys leave, one after the other."""
    text = ""
    for codes in visits:
        for code in codes:
            if code == "Backspace":
                text = text[:-1]
            else:
                text += KEY_TEXT.get(code, code[-1])
        text = text.strip("\n")
    return text


@pytest.mark.parametrize("size", [2, 1000])
def test_typing_in_pieces_equals_typing_at_once(make_log, size):
    """Edits reduced block by block give the text that replaying all keys gives."""
    draw = random.Random(11)
    expected, events = {}, []
    for student in range(1, 61):
        visits = [
            [draw.choice(["Digit1", "KeyA", "Enter", "Enter", "Backspace", "Backspace"]) for _ in range(draw.randint(0, 9))]
            for _ in range(draw.randint(1, 6))
        ]
        expected[student] = replay(visits)
        for codes in visits:
            events += visit("A", *codes, student=student)
    log = make_log([(s, n, i, v, x) for n, (s, i, v, x) in enumerate(events)])
    visits_ = answers.with_visits(answers.in_force(log))
    edits = answers.keystroke_edits(visits_, KEY)
    reduced = answers.reduced(edits, [STUDENT, ITEM, "blank"], size=size)
    kept = F.element_at("edits", -1)
    text = F.trim(F.substring(kept, F.lit(2), F.length(kept)), F.lit("\n"))
    assert {r[0]: r[1] for r in reduced.select(STUDENT, text).collect()} == expected


@pytest.mark.parametrize(
    ("edits", "expected"),
    [
        (["+ab", "-1", "+c"], ["+ac"]),
        (["-1", "-1", "+a", "-2"], ["-3", "+"]),
        (["+a", "~", "~"], ["+a"]),
        (["+\n", "~", "~", "-2", "~", "+x\n"], ["~", "-2", "~", "+x\n"]),
        ([], ["+"]),
    ],
)
def test_shortest_edits(spark, edits, expected):
    df = spark.createDataFrame([(edits,)], "e array<string>")
    assert df.select(answers.reduce_edits(F.col("e"))).first()[0] == expected


def scores(make_log, *visits, key=KEY):
    log = log_of(make_log, *visits)
    return scoring.scored(answers.responses(log, log.select(STUDENT).distinct(), key), key)


def test_scores(make_log):
    found = scores(make_log, visit("A", "Digit1", "Digit2"), visit("B", ("Digit1", 1), ("Digit5", 2)))
    assert rows(found, ITEM, "score") == [("A", 1), ("B", 1), ("C", None), ("D", None), ("E", None)]
    table = scoring.score_matrix(found, KEY).first().asDict()
    assert (table["A"], table["B"], table["C"]) == ("1", "1", NOT_DONE)
    empty = scores(make_log, visit("B"))
    assert rows(empty.where(F.col(ITEM) == "B"), "status", "score") == [("answered", 0)]


def test_backslashes_around_an_answer_do_not_count(make_log):
    found = scores(make_log, visit("A", "Slash", "Digit1", "Digit2", "Slash"))
    assert rows(found.where(F.col(ITEM) == "A"), "score") == [(1,)]


def test_match_score(make_log):
    drops = [(1, "D", "DropChoice", '[{"source":"1","target":2},{"source":"2","target":2},{"source":"4","target":4}]')]
    assert rows(scores(make_log, visit("D") + drops).where(F.col(ITEM) == "D"), "score") == [(2,)]


def test_matrix_has_every_student_once(make_log, spark):
    log = log_of(make_log, visit("A", "Digit1"))
    roster = spark.createDataFrame([(1, True), (9, False)], "student_id long, label boolean")
    table = answers.response_matrix(answers.responses(log, roster, KEY), KEY)
    one, nine = table.orderBy(STUDENT).collect()
    assert (one["A"], one["B"]) == ("1", NOT_DONE)
    assert [nine[i] for i in KEY] == [NOT_DONE] * 5 and nine["label"] is False


def test_option_share_among_those_who_got_the_easy_item(make_log):
    key = {"C": ("choice", [["3"]]), "F": ("choice", [["1"]])}

    def click(student, item, n):
        return [(student, item, "Enter Item", None), (student, item, "Click Choice", f"{item}_{n}:checked")]

    picks = [(1, 3, 1), (2, 3, 2), (3, 3, 2), (4, 1, 1)]
    found = scores(make_log, *[click(s, "C", c) + click(s, "F", f) for s, c, f in picks], key=key)
    share = scoring.conditional_option_share(found, easiest=1).where(F.col(ITEM) == "F")
    assert rows(share.select("option", "students", "answered", F.round("share", 3))) == [("1", 1, 3, 0.333), ("2", 2, 3, 0.667)]


def test_right_means_all_slots(make_log):
    full, part = [("1", 2), ("2", 3), ("3", 1), ("4", 4)], [("1", 2), ("2", 2), ("3", 3), ("4", 1)]
    key = {"D": ("match", [["2"], ["3"], ["1"], ["4"]]), "C": ("choice", [["3"]])}

    def drops(student, pairs):
        info = "[" + ",".join(f'{{"source":"{s}","target":{t}}}' for s, t in pairs) + "]"
        return [(student, "D", "Enter Item", None), (student, "D", "DropChoice", info)]

    def click(student, n):
        return [(student, "C", "Enter Item", None), (student, "C", "Click Choice", f"C_{n}:checked")]

    found = scores(make_log, drops(1, full), click(1, 3), drops(2, part), click(2, 3), drops(3, full), click(3, 1), key=key)
    assert rows(found.where(F.col(ITEM) == "D"), "score", "is_right") == [(1, False), (4, True), (4, True)]
    assert rows(scoring.item_right_share(found).select(ITEM, F.round("right_share", 3))) == [("C", 0.667), ("D", 0.667)]
    both = scoring.conditional_option_share(found, easiest=2)
    assert rows(both, ITEM, "option", "students") == [("C", "3", 1), ("D", "2|3|1|4", 1)]


def test_published_key(spark):
    table = answer_key(spark)
    assert table.count() == len(ANSWER_KEY) == 19
    kinds = dict(rows(table.groupBy("kind").count()))
    assert kinds == {"choice": 14, "blank": 2, "blanks": 1, "composite": 1, "match": 1}
