"""Documents that hold benchmark questions, also with other numbers, names and units.

Words become a template: numbers, units and names (capitalised words that are no function words) turn into
typed placeholders, all others into their lower-case form without the punctuation around them. A number with letters behind it is
two words ("5km"), an ordinal one number ("3rd"), and names next to each other are one ("New York"). A capitalised word that opens a
sentence may be a name or not: windows with such a word are hashed under both readings.
Windows of WINDOW template words of all documents are joined by hash with the benchmark's; an
item of fewer words is a window of its own length. A window counts if at least half of its words are
literal, so no placeholder pattern matches by itself. For each document and item, values of the
matched windows' slots are compared: a question whose parameters were changed maps each value to
one other value wherever it occurs. Pairs with at least MIN_COVERED of the item's windows (by place, under either reading)
and MIN_CONSISTENT of its slot values mapped one to one, both ways, are leaks. Where the matches of a whole
document fail that, each occurrence in it is judged alone, so a copy is found beside variants of itself with
other values. An occurrence is what matches at one distance between the document's place and the item's, or
at up to SLACK neighbouring ones, as a word put in shifts what follows.

With `verbatim`, as the queries and the pipeline set it, windows of the lower-case words themselves are joined
as well, whatever their kinds: a place in a document with MIN_COVERED of an item's windows, or with a run
of RUN words of it, however long the item, is a leak too. So items of numbers, names or capitals
are found as they are, and long passages of long items.

The benchmark's window hashes are sent to the tasks, as a filter, while there are no more than
`max_filter` of them (8 bytes each); beyond that, all windows go to the join, with the same
result. Nothing is gathered per document but its matches, which are counted in partial aggregations,
so a question in a third of all documents is no hot group.

Null and empty texts match nothing, as do items without a literal majority unless `verbatim` is set. Rows of equal id are one
document; a null id is none and never leaks. Repeated items count once per item id, and items of null id
never match. Columns other than ids and texts don't matter. Without documents or items, the result is
empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import carried
from logloom.llm.tokens import groups
from logloom.llm.words import Words, hashes, windows, words_of
from logloom.session import settle

WINDOW = 8
MIN_COVERED = 0.5
MIN_CONSISTENT = 0.8
SLACK = 4
RUN = 13
AS_IS = np.uint64(0xA0761D6478BD642F)  # sets windows of words apart from templates
MAX_FILTER = 4_000_000
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
#: Unit words, by the hash of their lower-case form.
UNITS = [
    "%", "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ounce", "ounces", "pound", "pounds",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds",
    "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
    "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "degree", "degrees",
    "percent", "meter", "meters", "metre", "metres", "kilometer", "kilometers",
]


#: Words that are no names, however they are written, and endings of ordinals.
FUNCTION_WORDS = [
    "a", "an", "the", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "my", "your",
    "his", "her", "its", "our", "their", "there", "here", "who", "whose", "which", "what", "when", "where", "why", "how",
    "if", "in", "on", "at", "by", "for", "from", "of", "to", "with", "without", "after", "before", "during", "since", "until",
    "between", "and", "but", "or", "so", "then", "thus", "also", "as", "because", "while", "each", "every", "all", "both",
    "some", "any", "no", "not", "other", "another", "find", "calculate", "compute", "determine", "solve", "let", "suppose",
    "assume", "given", "consider", "write", "use", "show", "choose", "is", "are", "was", "were", "be", "do", "does", "did",
    "can", "could", "will", "would", "should", "has", "have", "had",
]
ORDINALS = ["st", "nd", "rd", "th"]


def byte_set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


LEADING, TRAILING, STOPS, DIGITS = byte_set("([{\"'"), byte_set(".,;:!?)]}\"'"), byte_set(".!?:"), byte_set("0123456789")
#: What a number may have besides digits.
IN_NUMBER = byte_set("0123456789.,/:%$+-")
LETTERS = byte_set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def hashes_of(texts: list[str]) -> np.ndarray:
    words = words_of(pa.array(texts))
    return np.sort(hashes(words.data, words.starts, words.ends))


UNIT_HASHES, FUNCTION_HASHES, ORDINAL_HASHES = hashes_of(UNITS), hashes_of(FUNCTION_WORDS), hashes_of(ORDINALS)


@dataclass
class Tokens:
    """Words of texts in order: the text of each, its value (a hash), its kind and its place in the text."""

    texts: int
    text: np.ndarray
    value: np.ndarray
    kind: np.ndarray
    place: np.ndarray

    def __post_init__(self):
        self.firsts = np.searchsorted(self.text, np.arange(self.texts + 1))
        self.last = self.firsts[1:][self.text]

    def starts(self, size: int) -> np.ndarray:
        """First words of all windows."""
        at = np.arange(len(self.text))
        return at[at + size <= self.last]

    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)


def places(text: np.ndarray) -> np.ndarray:
    """The number of each word in its text."""
    return np.arange(len(text)) - np.searchsorted(text, text)


@dataclass
class Windows:
    """Windows of one size and kind: first words and hashes."""

    tokens: Tokens
    size: int
    exact: bool
    at: np.ndarray
    hashed: np.ndarray

    def where(self, chosen: np.ndarray) -> Windows:
        return replace(self, at=self.at[chosen], hashed=self.hashed[chosen])

    def texts(self) -> np.ndarray:
        return self.tokens.text[self.at]

    def slots(self) -> pa.ListArray:
        """The values of each window's slots."""
        inside = self.at[:, None] + np.arange(self.size)
        filled = self.tokens.kind[inside] != LITERAL if not self.exact else np.zeros(inside.shape, bool)
        ends = np.concatenate([[0], np.cumsum(filled.sum(axis=1))])
        values = self.tokens.value[inside[filled]].astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))


class Template:
    """The words of texts as they are, and as templates under two readings of words that open a sentence."""

    def __init__(self, texts: pa.Array):
        words = words_of(texts)
        data, starts, ends, text = words.data, words.starts.copy(), words.ends.copy(), words.texts()
        opens = self.opening(words, text)
        self.trim(data, starts, ends)
        full = ends > starts
        # A sentence that opens with a word of punctuation opens with the next one as well.
        for i in np.flatnonzero(~full & opens):
            if i + 1 < len(opens) and text[i + 1] == text[i]:
                opens[i + 1] = True
        starts, ends, text, opens = starts[full], ends[full], text[full], opens[full]
        value = hashes(data, starts, ends)
        self.words = Tokens(len(texts), text, value, np.zeros(len(text), np.uint8), places(text))
        starts, ends, text, opens = self.split_numbers(data, starts, ends, text, opens)
        value = hashes(data, starts, ends)
        kind, maybe = self.kinds(data, starts, ends, value, opens)
        # As names first; then, where that makes a difference, as ordinary words. Places are those of the first reading.
        readings = [self.merged(data, starts, ends, text, k) for k in (kind, np.where(maybe, LITERAL, kind))]
        number = np.zeros(len(text), np.int64)
        number[readings[0][0]] = 1
        number = np.cumsum(number) - 1
        place = places(text[readings[0][0]])
        self.readings = []
        for firsts, own_kind, own_value in readings:
            tokens = Tokens(len(texts), text[firsts], own_value, own_kind, place[number[firsts]])
            form = np.where(own_kind == LITERAL, own_value, own_kind.astype(np.uint64))
            either = np.add.reduceat(maybe, firsts) > 0 if len(firsts) else np.zeros(0, bool)
            self.readings.append((tokens, form, either))

    @staticmethod
    def opening(words: Words, text: np.ndarray) -> np.ndarray:
        """Words that open a sentence: after a full stop, a line's end, or nothing."""
        data, starts, ends = words.data, words.starts, words.ends
        opens = np.ones(len(starts), bool)
        if len(starts):
            lines = np.concatenate([[0], np.cumsum(data == 10)])
            # The punctuation that a word ends with, quotes and brackets aside.
            tail = ends - 1
            for _ in range(2):
                closing = (tail > starts) & np.isin(data[tail], list(b")]}\"'"))
                tail = tail - closing
            opens[1:] = (text[1:] != text[:-1]) | STOPS[data[tail[:-1]]] | (lines[starts[1:]] > lines[ends[:-1]])
        return opens

    @staticmethod
    def trim(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Move starts and ends inwards over punctuation."""
        todo = np.arange(len(starts))
        while len(todo := todo[(ends[todo] > starts[todo])]):
            todo = todo[TRAILING[data[ends[todo] - 1]]]
            ends[todo] -= 1
        todo = np.arange(len(starts))
        while len(todo := todo[(ends[todo] > starts[todo])]):
            todo = todo[LEADING[data[starts[todo]]]]
            starts[todo] += 1

    @staticmethod
    def split_numbers(data, starts, ends, text, opens) -> tuple[np.ndarray, ...]:
        """Letters behind a number become a word of their own; those of an ordinal go."""
        digits, letters = (np.concatenate([[0], np.cumsum(chars[data])]) for chars in (DIGITS, LETTERS))
        other = np.append(np.flatnonzero(~IN_NUMBER[data]), len(data))
        stop = np.minimum(other[np.searchsorted(other, starts)], ends) if len(starts) else starts
        mixed = (stop < ends) & (digits[stop] > digits[starts]) & (letters[ends] - letters[stop] == ends - stop)
        at = np.flatnonzero(mixed)
        ordinal = np.isin(hashes(data, stop[at], ends[at]), ORDINAL_HASHES)
        suffix = at[~ordinal]
        behind_starts, behind_ends = stop[suffix], ends[suffix]
        ends = np.where(mixed, stop, ends)
        place = suffix + 1
        return (
            np.insert(starts, place, behind_starts), np.insert(ends, place, behind_ends),
            np.insert(text, place, text[suffix]), np.insert(opens, place, False),
        )

    @staticmethod
    def kinds(data, starts, ends, value, opens) -> tuple[np.ndarray, np.ndarray]:
        """Kind of each word, and which names may be ordinary words that open a sentence."""
        lead = data[starts] if len(starts) else np.zeros(0, np.uint8)
        second = data[np.minimum(starts + 1, max(len(data) - 1, 0))] if len(starts) else lead
        capital = (lead >= 65) & (lead <= 90) | (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        in_number, digits = (np.concatenate([[0], np.cumsum(chars[data])]) for chars in (IN_NUMBER, DIGITS))
        is_number = (in_number[ends] - in_number[starts] == ends - starts) & (digits[ends] > digits[starts])
        is_unit = np.isin(value, UNIT_HASHES)
        is_name = capital & ~np.isin(value, FUNCTION_HASHES)
        kind = np.select([is_number, is_unit, is_name], [NUMBER, UNIT, NAME], LITERAL).astype(np.uint8)
        return kind, (kind == NAME) & opens

    @staticmethod
    def merged(data, starts, ends, text, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, kinds and values of the words with names next to each other as one."""
        joins = np.zeros(len(kind), bool)  # to the word before
        joins[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & (text[1:] == text[:-1]) & (starts[1:] - ends[:-1] == 1)
        firsts = np.flatnonzero(~joins)
        lasts = np.append(firsts[1:], len(kind)) - 1
        value = hashes(data, starts[firsts], ends[lasts]) if len(firsts) else np.zeros(0, np.uint64)
        return firsts, kind[firsts].astype(np.uint8), value

    def windows(self, size: int, verbatim: bool) -> list[Windows]:
        """Those of the templates that have a literal majority, and if wanted those of the words as they are."""
        out = []
        for number, (tokens, form, either) in enumerate(self.readings):
            literal, two = (np.concatenate([[0], np.cumsum(x)]) for x in (tokens.kind == LITERAL, either))
            at = tokens.starts(size)
            at = at[2 * (literal[at + size] - literal[at]) >= size]
            if number:
                at = at[two[at + size] > two[at]]
            out.append(Windows(tokens, size, False, at, windows(form, size)[at] ^ np.uint64(size)))
        if verbatim:
            at = self.words.starts(size)
            out.append(Windows(self.words, size, True, at, windows(self.words.value, size)[at] ^ np.uint64(size) ^ AS_IS))
        return out


def window_rows(part: pa.RecordBatch, found: list[Windows]) -> pa.RecordBatch:
    """The windows with their places in their own texts."""
    names = ["id", "part", "place", "hash", "exact", "values", "length"]
    kinds = [part.column("id").type, pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int64()]
    tables = []
    for w in found:
        text = w.texts()
        at = pa.array(text, pa.int64())
        columns = [
            part.column("id").take(at), part.column("part").take(at), pa.array(w.tokens.place[w.at], pa.int64()),
            pa.array(w.hashed.astype(np.int64)), pa.array(np.full(len(at), w.exact)), w.slots(), pa.array(np.full(len(at), w.size, np.int64)),
        ]
        tables.append(pa.Table.from_arrays(columns, names))
    whole = pa.concat_tables(tables).combine_chunks() if tables else pa.schema(list(zip(names, kinds, strict=True))).empty_table()
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in whole.columns], names)


WINDOW_SCHEMA = "id {kind}, part long, place long, hash long, exact boolean, values array<long>, length long"


def item_windows(items: DataFrame, size: int, verbatim: bool) -> DataFrame:
    """`item`, `item_part`, `item_place`, `hash`, `exact`, `length` and `item_values` of the windows of the items (id, part, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in groups(batch.column("text")):
                part = batch.slice(start, stop - start)
                template = Template(part.column("text"))
                most = template.readings[0][0].counts()
                for tokens in (template.words, template.readings[1][0]):
                    most = np.maximum(most, tokens.counts())
                found = []
                for length in range(1, min(size, int(most.max(initial=0))) + 1):
                    for w in template.windows(length, verbatim):
                        found.append(w.where(np.minimum(w.tokens.counts()[w.texts()], size) == length))
                yield window_rows(part, found)

    rows = items.mapInArrow(run, WINDOW_SCHEMA.format(kind=dict(items.dtypes)["id"]))
    return rows.withColumnsRenamed({"id": "item", "part": "item_part", "place": "item_place", "values": "item_values"})


def document_windows(docs: DataFrame, lengths: list[int], wanted: np.ndarray | None, verbatim: bool) -> DataFrame:
    """`doc`, `part`, `place`, `hash`, `exact` and `values` of the windows of the documents (id, part, text), only of the hashes in `wanted` if given."""
    if wanted is not None:
        bits = np.zeros(1 << 22, bool)  # most windows end here, before the search
        bits[(wanted & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        shared = docs.sparkSession.sparkContext.broadcast((np.packbits(bits), wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wanted is not None:
            packed, known = shared.value
            may_be = np.unpackbits(packed).view(bool)
        for batch in batches:
            for start, stop in groups(batch.column("text")):
                part = batch.slice(start, stop - start)
                template = Template(part.column("text"))
                found = [w for length in lengths for w in template.windows(length, verbatim)]
                if wanted is not None:
                    found = [w.where(may_be[(w.hashed & np.uint64(len(may_be) - 1)).astype(np.int64)]) for w in found]
                    near = [known[np.minimum(np.searchsorted(known, w.hashed), len(known) - 1)] == w.hashed for w in found]
                    found = [w.where(n) for w, n in zip(found, near, strict=True)]
                yield window_rows(part, found)

    rows = docs.mapInArrow(run, WINDOW_SCHEMA.format(kind=dict(docs.dtypes)["id"]))
    return rows.drop("length").withColumnRenamed("id", "doc")


def judged(matches: DataFrame, totals: DataFrame, keys: list[str], min_covered: float) -> DataFrame:
    """`keys`, `covered` and `consistent` of the groups of matches that cover enough of their item."""
    place = [c for c in ("item_part", "item_place") if c not in keys]
    covered = (
        matches.select(*keys, *place).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("hit"))
        .join(totals, "item").select(*keys, (F.col("hit") / F.col("windows")).alias("covered")).where(F.col("covered") >= min_covered)
    )
    # Pairs of an item's value and a document's value, and on how many partners each has.
    slots = (
        matches.select(*keys, F.explode(F.arrays_zip(F.col("item_values").alias("theirs"), F.col("values").alias("own"))).alias("slot"))
        .select(*keys, "slot.theirs", "slot.own").distinct()
    )
    by_theirs = slots.groupBy(*keys, "theirs").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("own"))
    by_own = slots.groupBy(*keys, "own").agg(F.count(F.lit(1)).alias("m"))
    consistent = (
        by_theirs.join(by_own, [*keys, "own"])
        .groupBy(*keys)
        .agg(F.avg(((F.col("n") == 1) & (F.col("m") == 1)).cast("int")).alias("consistent"))
    )
    return covered.join(consistent, keys, "left").withColumn("consistent", F.coalesce("consistent", F.lit(1.0)))


def occurrences(matches: DataFrame) -> DataFrame:
    """The matches with `start` and `slack` of each occurrence they may belong to."""
    shift = F.col("place") - F.col("item_place")
    at = [F.struct((shift - back).alias("start"), F.lit(slack).alias("slack")) for slack in (0, SLACK) for back in range(slack + 1)]
    return matches.withColumn("at", F.explode(F.array(*at))).select("*", "at.start", "at.slack").drop("at")


def passages(matches: DataFrame, known: DataFrame, window: int, min_covered: float) -> DataFrame:
    """`doc`, `item`, `covered` and `consistent` of the items that documents hold word by word, whole or for long."""
    text = ["item", "item_part"]
    at = ["doc", "part", *text, "shift"]
    totals = known.select(*text, "item_place").distinct().groupBy(*text).agg(F.count(F.lit(1)).alias("windows"))
    spots = matches.select("doc", "part", *text, (F.col("place") - F.col("item_place")).alias("shift"), "item_place").distinct()
    # Places in a row less their rank are one number.
    order = F.row_number().over(Window.partitionBy(*at).orderBy("item_place"))
    runs = spots.withColumn("run", F.col("item_place") - order).groupBy(*at, "run").agg(F.count(F.lit(1)).alias("n"))
    found = runs.groupBy(*at).agg(F.max("n").alias("longest"), F.sum("n").alias("hit")).join(totals, text)
    return (
        found.withColumn("covered", F.col("hit") / F.col("windows"))
        .where((F.col("covered") >= min_covered) | (F.col("longest") > max(RUN - window, 0)))
        .groupBy("doc", "item")
        .agg(F.max("covered").alias("covered"))
        .withColumn("consistent", F.lit(1.0))
    )


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    min_covered: float = MIN_COVERED,
    min_consistent: float = MIN_CONSISTENT,
    max_filter: int = MAX_FILTER,
    verbatim: bool = False,
) -> DataFrame:
    """One row per document and item that it holds: the ids, `covered` and `consistent`."""

    def narrow(df: DataFrame, key: str, text: str) -> DataFrame:
        rows = df.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where("id IS NOT NULL")
        return rows.withColumn("part", F.xxhash64("text"))  # which of the texts of one id a place is in

    all_known = settle(item_windows(narrow(items, item_column, item_text_column), window, verbatim))
    known = all_known.where("NOT exact")
    totals = known.groupBy("item").agg(F.countDistinct("item_part", "item_place").alias("windows"))
    lengths = sorted(r.length for r in all_known.select("length").distinct().collect())  # `window` of them at most
    distinct = all_known.select("hash").distinct()
    wanted = None
    if distinct.count() <= max_filter:
        wanted = np.sort(distinct.toPandas()["hash"].to_numpy(np.int64).astype(np.uint64))
        if not len(wanted):
            lengths = []
    found = document_windows(narrow(docs, id_column, text_column), lengths, wanted, verbatim)
    all_matches = settle(found.join(all_known.select("item", "item_part", "item_place", "hash", "item_values"), "hash"))
    matches = all_matches.where("NOT exact")
    whole = settle(judged(matches, totals, ["doc", "item"], min_covered))
    # An occurrence covers no more than its document, so only these can still hold one that passes.
    mixed = whole.where(F.col("consistent") < min_consistent).select("doc", "item")
    single = (
        judged(occurrences(matches.join(mixed, ["doc", "item"])), totals, ["doc", "part", "item", "item_part", "start", "slack"], min_covered)
        .where(F.col("consistent") >= min_consistent)
        .groupBy("doc", "item")
        .agg(F.max(F.struct("covered", "consistent")).alias("best"))
        .select("doc", "item", "best.covered", "best.consistent")
    )
    result = whole.where(F.col("consistent") >= min_consistent).unionByName(single)
    if verbatim:
        as_is = passages(all_matches.where("exact"), all_known.where("exact"), window, min_covered)
        best = F.max(F.struct("covered", "consistent")).alias("best")
        result = result.unionByName(as_is).groupBy("doc", "item").agg(best).select("doc", "item", "best.*")
    return result.select(F.col("doc").alias(id_column), F.col("item").alias(item_column), "covered", "consistent")


def drop_leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", **settings) -> DataFrame:
    """The rows of `docs` that hold no item, with its columns only. Rows of null id stay."""
    # Written first, so that its size is known when the join is planned: while leaks are few, texts stay where they are.
    bad = settle(leaks(docs, items, id_column, **settings).select(F.col(id_column).alias("bad_id")).distinct())
    whole = carried(docs, id=F.col(f"`{id_column}`"))
    kept = whole.join(bad, whole["id"] == bad["bad_id"], "left_anti")
    return kept.select(*[kept["row"].getField(c).alias(c) for c in docs.columns])
