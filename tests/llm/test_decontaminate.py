"""Benchmark leaks against a plain reading of the rules, word by word."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from logloom.llm import decontaminate
from logloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
UNITS = set(decontaminate.UNITS)


def lowered(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def pieces(text):
    """(start, end, opens a sentence) of each word, numbers without the letters behind them."""
    out, opens, end = [], True, 0
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        opens = opens or "\n" in text[end : m.start()]
        raw, end = m.group(), m.end()
        tail = re.search(r"""[.,;:!?)\]}"']*$""", raw).start()
        head = re.match(r"""[(\[{"']*""", raw[:tail]).end()
        bare = raw
        for _ in range(2):
            if len(bare) > 1 and bare[-1] in ")]}\"'":
                bare = bare[:-1]
        stop = bare[-1] in ".!?:"
        if head < tail:
            first, last = m.start() + head, m.start() + tail
            mixed = re.fullmatch(r"([0-9.,/:%$+-]*[0-9][0-9.,/:%$+-]*)([A-Za-z]+)", text[first:last])
            if mixed is None:
                out.append((first, last, opens))
            else:
                out.append((first, first + mixed.end(1), opens))
                if lowered(mixed.group(2)) not in ("st", "nd", "rd", "th"):
                    out.append((first + mixed.end(1), last, False))
            opens = stop
        else:
            opens = opens or stop
    return out


def readings(text):
    """Twice the words (form, kind, value, place, may be read in two ways): openers as names, and as ordinary words."""
    text, out, places = text or "", [], []
    words = pieces(text)
    for reading in (0, 1):
        found = []
        for number, (start, end, opens) in enumerate(words):
            core = text[start:end]
            value = lowered(core)
            if re.fullmatch(r"[0-9.,/:%$+-]+", core) and re.search("[0-9]", core):
                kind = "number"
            elif value in UNITS:
                kind = "unit"
            elif re.match("[A-ZÀ-ÖØ-Þ]", core) and value not in decontaminate.FUNCTION_WORDS:
                kind = "name"
            else:
                kind = None
            maybe = kind == "name" and opens
            if maybe and reading:
                kind = None
            if found and kind == found[-1]["kind"] == "name" and len(text[found[-1]["end"] : start].encode()) == 1:
                found[-1] |= {"end": end, "maybe": found[-1]["maybe"] or maybe}
            else:
                found.append({"start": start, "end": end, "kind": kind, "maybe": maybe, "number": number})
            if not reading:
                places.append(len(found) - 1)
        out.append([])
        for w in found:
            value = lowered(text[w["start"] : w["end"]])
            out[-1].append((value if w["kind"] is None else f"<{w['kind']}>", w["kind"], value, places[w["number"]], w["maybe"]))
    return out


def windows(text, size=None):
    """(forms, values, place) of the windows of `size` words, or of 8 or as many as there are."""
    for reading, words in enumerate(readings(text)):
        own = min(8, len(words)) if size is None else size
        for i in range(len(words) - own + 1 if own else 0):
            part = words[i : i + own]
            if 2 * sum(k is None for _, k, *_ in part) >= own and (not reading or any(m for *_, m in part)):
                yield tuple(f for f, *_ in part), [v for _, k, v, *_ in part if k], part[0][3]


def passes(matches, places):
    """Whether matches (item place, item values, values) cover an item of so many places, one to one."""
    if not matches or len({place for place, *_ in matches}) < 0.5 * places:
        return False
    pairs = {p for _, theirs, own in matches for p in zip(theirs, own, strict=True)}
    first = {a for a, _ in pairs}
    good = [a for a in first if len(b := {y for x, y in pairs if x == a}) == 1 and len({x for x, y in pairs if y in b}) == 1]
    return not first or len(good) >= 0.8 * len(first)


def plain(docs, items):
    """A document as a whole, or one occurrence: matches at one distance, or at up to 4 neighbouring ones."""
    found = set()
    known = {item: list(windows(text)) for item, text in items if item is not None}
    sizes = {len(form) for theirs in known.values() for form, *_ in theirs}
    by_doc = defaultdict(lambda: defaultdict(list))
    for number, (doc, text) in enumerate(docs):
        if doc is not None:
            for size in sizes:
                for form, values, place in windows(text, size):
                    by_doc[doc][form].append((number, place, values))
    for doc, own in by_doc.items():
        for item, theirs in known.items():
            places = len({place for *_, place in theirs})
            matches = [(number, at - place, place, values, other) for form, values, place in theirs for number, at, other in own.get(form, [])]
            groups = defaultdict(list)
            for number, shift, *match in matches:
                groups["whole"].append(match)
                for slack in (0, decontaminate.SLACK):
                    for back in range(slack + 1):
                        groups[number, shift - back, slack].append(match)
            if any(passes(group, places) for group in groups.values()):
                found.add((doc, item))
    return found


QUESTION = "A train leaves Boston at 9 and covers 120 miles in 3 hours before it meets Alice, who walked 4 miles from home to the station where the train had left."
ITEMS = [
    (1, QUESTION),
    (2, "Short question of six words?"),
    (3, "12 30 45 km kg 7 8 9 10 11"),
    (4, None),
    (None, QUESTION),
    (5, ""),
    (6, "Every farmer in the valley owns 15 sheep, and each sheep gives 3 kg of wool, so how much wool does Maria sell when Peter buys 6 kg of it?"),
    (6, "Every farmer in the valley owns 15 sheep, and each sheep gives 3 kg of wool, so how much wool does Maria sell when Peter buys 6 kg of it?"),
]
DOCS = [
    (1, f"Some words before.\n{QUESTION}\nAnd after."),
    (2, QUESTION.replace("Boston", "Denver").replace("120", "310").replace("3 hours", "5 hours").replace("Alice", "Bob").replace(" 4 miles", " 8 kilometers").replace("120 miles", "310 kilometers")),
    (3, QUESTION.replace("Alice", "Bob").replace("miles", "km").replace("3 hours", "6 hours")),
    (4, "it said: short question of six words? yes"),
    (5, "Nothing of the kind is here, only 9 and 120 miles in 3 hours."),
    (6, "1 2 3 km kg 4 5 6 7 8 and 12 30 45 km kg 7 8 9 10 11"),
    (7, None),
    (8, ""),
    (None, QUESTION),
    (9, "x " * 40_000 + QUESTION + " y" * 10),
    (10, "Every farmer in the valley owns 15 sheep, and each sheep gives 15 kg of wool, so how much wool does Anna sell when Anna buys 15 kg of it?"),
    (1, "the same id again"),
    (11, "Every farmer in the valley owns 20 sheep, and each sheep gives 4 kg of wool, so how much wool does Anna sell when Lena buys 9 kg of it?"),
]


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def found(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


@pytest.mark.parametrize("limit", [0, 4_000_000])
def test_odd_rows(spark, limit):
    docs, items = tables(spark, DOCS, ITEMS)
    result = decontaminate.leaks(docs, items, max_filter=limit)
    assert found(result) == plain(DOCS, ITEMS)
    assert {(1, 1), (2, 1), (9, 1), (11, 6), (4, 2)} <= found(result)
    assert not {d for d, _ in found(result)} & {5, 6, 7, 8, 10}


def test_empty_tables(spark):
    docs, items = tables(spark, DOCS, ITEMS)
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_leaks(docs, items.limit(0)).count() == len(DOCS)


def test_clean_rows_stay_as_they_are(spark):
    docs, items = tables(spark, DOCS, ITEMS)
    wide = docs.selectExpr("doc_id", "text", "1 AS id", "'r' AS row", "2 AS bad_id")
    kept = decontaminate.drop_leaks(wide, items)
    bad = {d for d, _ in plain(DOCS, ITEMS)}
    assert kept.columns == wide.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str(d) for d in DOCS if d[0] not in bad)


def test_random_texts(spark):
    rng = random.Random(11)
    vocabulary = ["ab", "cd", "Ef", "gh.", "12", "3.5", "km", "(ij", "kl)", "--", "...", "Öl", "mn:\n", "op\n", "'q'", "90%", "!", "Rs", "5km", "3rd.", "The", "Tu", "+4ab", "x5", "$7k9"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(60)]
    items = [(i, " ".join(docs[rng.randrange(60)][1].split(" ")[a : a + rng.randrange(14)])) for i in range(30) if (a := rng.randrange(20)) + 1]
    assert found(decontaminate.leaks(*tables(spark, docs, items))) == plain(docs, items)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    result = found(QUERIES["op3_template_leaks"](spark, DATA))
    assert result == plain(docs, items)
    assert {(d, i) for d, t in docs for i, x in items if x in t} <= result


def test_a_copy_beside_variants(spark):
    other = QUESTION.replace("Boston", "Denver").replace("120", "310").replace("3 hours", "5 hours").replace("Alice", "Bob").replace(" 4 miles", " 8 miles")
    third = other.replace("Denver", "New York").replace("310", "77").replace("Bob", "Eve").replace("at 9", "at 11")
    worn = dict(d for d in DOCS if d[0] == 10)[10]  # its values are not one to one
    docs = [
        (1, f"{QUESTION}\n{other}"),
        (2, f"{other}\nSome words.\n{'y ' * 3000}\n{third}"),
        (3, QUESTION),
        (3, other),
        (4, f"{worn} {worn}\n{worn}"),
        (5, f"{worn} " + ITEMS[6][1]),
    ]
    items = [(1, QUESTION), (6, ITEMS[6][1])]
    for limit in (0, 4_000_000):
        result = decontaminate.leaks(*tables(spark, docs, items), max_filter=limit)
        assert found(result) == {(1, 1), (2, 1), (3, 1), (5, 6)}
        assert {(r.covered, r.consistent) for r in result.collect() if r.doc_id in (1, 5)} == {(1.0, 1.0)}


def test_verbatim_passages(spark):
    rng = random.Random(4)
    long = " ".join(rng.choices([f"w{i}" for i in range(500)], k=59))
    title = "The Old Man And The Sea Was Written By Ernest Hemingway In Cuba"
    numbers = "12 30 45 km kg 7 8 9 10 11"
    items = [(1, long), (2, title), (3, numbers), (4, QUESTION), (5, "1 + 2")]
    docs = [
        (1, "before " + " ".join(long.split()[20:45]) + " after"),
        (2, f"They read: {title}, again."),
        (3, f"A table\n{numbers}\nof numbers."),
        (4, QUESTION.upper()),
        (5, numbers.replace("45", "46").replace("9", "99")),
        (6, " ".join(long.split()[20:32]) + " after"),
        (7, "so 1 + 2 is"),
        (8, "so 1 + 3 is"),
    ]
    for limit in (0, 4_000_000):
        assert found(decontaminate.leaks(*tables(spark, docs, items), max_filter=limit, verbatim=True)) == {(1, 1), (2, 2), (3, 3), (4, 4), (7, 5)}
    kept = decontaminate.drop_leaks(*tables(spark, docs, items), verbatim=True)
    assert sorted(r.doc_id for r in kept.collect()) == [5, 6, 8]


def test_query_finds_passages(spark, tmp_path):
    docs, items = tables(spark, [(1, "see 12 30 45 km kg 7 8 9 10 11 there")], [(3, ITEMS[2][1])])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert found(QUERIES["op3_template_leaks"](spark, str(tmp_path))) == {(1, 3)}


TOM = "Tom has 3 apples. Tom buys 4 more apples at the market and gives 2 apples to Ann. How many apples does Tom have in the end?"
RACE = "In the race of 5km through Paris the 3rd runner carries a bag of 20kg for 35 minutes, while the last one with a bag of 35kg needs 50 minutes more than that."
SHORT = "Trains from Oslo need 3 hours."


def test_other_parameters_in_the_words_of_real_questions(spark):
    """Names that open sentences, names of several words, units and ordinals on their numbers, and items of one window."""
    items = [(1, TOM), (2, RACE), (3, SHORT)]
    changed = {
        1: TOM.replace("Tom", "Ann-Marie").replace("Ann.", "Bob.").replace("3", "13").replace("4", "24").replace("2", "5"),
        2: RACE.replace("5km", "7km").replace("Paris", "New York").replace("3rd", "2nd").replace("20kg", "15kg").replace("35kg", "45kg").replace("35 ", "55 ").replace("50 ", "70 "),
        3: SHORT.replace("Oslo", "Rio de Janeiro".split()[0]).replace("3", "9"),
    }
    docs = [(i, f"Some text. {t}") for i, t in changed.items()] + [(10 + i, t) for i, t in items] + [(20 + i, f"He wrote: {t}") for i, t in items]
    docs.append((4, f"1) {TOM.replace('Tom', 'Mary Ann')}"))
    docs.append((5, "they said that trains from Berlin need 8 hours."))
    # Values that don't map one to one.
    docs.append((31, TOM.replace("Tom buys", "Eva buys").replace("does Tom", "does Kim").replace("3", "2").replace("4", "2")))
    docs.append((32, RACE.replace("35kg", "20kg").replace("35 ", "20 ").replace("50 ", "20 ")))
    expected = {(i, i) for i in (1, 2, 3)} | {(10 + i, i) for i in (1, 2, 3)} | {(20 + i, i) for i in (1, 2, 3)} | {(4, 1), (5, 3)}
    assert plain(docs, items) == expected
    for limit in (0, 4_000_000):
        assert found(decontaminate.leaks(*tables(spark, docs, items), max_filter=limit)) == expected
