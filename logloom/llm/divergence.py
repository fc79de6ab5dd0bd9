"""How far the sources of a language are apart, term by term, in exact whole numbers.

Terms are runs of letters (A-Z in lower case) and of characters beyond ASCII. Tasks count the terms of
their documents, by group (language, source), before anything is shuffled. A language keeps the terms of at least
`least` of its documents. A term's share in a group follows from its count there alone, so the divergence of
two groups is a sum over pairs of counts: the number of terms with count a in one and b in the other,
times f(share of a, share of b).

Those numbers come from bitmaps. The terms of a language are dealt into chunks by their hashes and numbered inside them; a group
has one set of term numbers per chunk and count, stored as its 64-bit words that aren't empty. For two groups,
AND and popcount of two sets give the cell of two counts; what a set has beyond its cells are terms with
a count of zero on the other side, and terms in no set have zero on both. A task gets the bitmaps of a chunk for two
blocks of groups, BLOCK of each at most on average, and gives one partial sum per pair of groups. So what a task holds is bounded
by CHUNK and BLOCK, whatever the vocabulary and the number of sources; a frequent term is one bit per
group.

Null text, language and source are ''. Rows of equal id are separate documents; ids aren't read. Groups without
terms have counts of zero; a language without kept terms has pairs of value 0 and no terms. Equal values are ranked by the item's UTF-8 bytes. Extra columns don't
matter. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.tokens import groups
from logloom.session import settle

#: Terms of a chunk, and groups of a block, on average.
CHUNK, BLOCK = 1024, 64
#: Counts, or terms, that a task holds before it hands them on.
HELD = 1_500_000
#: Words that are ANDed at once.
CELLS = 1 << 21
#: Shares are out of so many.
UNIT = 1_000_000_000

#: Letters lower-cased, bytes of characters beyond ASCII as they are, all others a space.
TERM_BYTES = np.full(256, ord(" "), np.uint8)
TERM_BYTES[128:] = np.arange(128, 256)
TERM_BYTES[ord("a") : ord("z") + 1] = TERM_BYTES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Text and code of each term in order, and the terms by code."""
    texts = texts.cast(pa.large_string())
    _, offsets, body = texts.buffers()
    mapped = TERM_BYTES[np.frombuffer(body, np.uint8)] if body is not None else np.zeros(0, np.uint8)
    clean = pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(mapped), None, 0, texts.offset)
    words = pc.ascii_split_whitespace(clean)
    text = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    flat = words.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(real).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return text[real.to_numpy(zero_copy_only=False)], code, coded.dictionary.to_numpy(zero_copy_only=False).tolist()


class Counts:
    """Counts of (group, term) in a task, under numbers that are the task's own."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[str, int] = {}
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, keys: list[tuple[str, str]], texts: pa.Array) -> None:
        text, code, terms = terms_of(texts)
        known = self.terms
        number = np.array([known.setdefault(t, len(known)) for t in terms], np.int64)
        group = np.array([self.groups.setdefault(k, len(self.groups)) for k in keys], np.int64)
        # Once per document first: its terms are counted in few numbers.
        width = max(1, len(terms))
        once, n = np.unique(text * width + code, return_counts=True)
        key = group[once // width] << 40 | number[once % width]
        self.hold(key, n, np.ones(len(key), np.int64))

    def hold(self, key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        """Add up equal keys, and whenever as many have come again, with those held."""
        self.held.append(self.merged([(key, n, docs)]))
        self.rows += len(self.held[-1][0])
        if len(self.held) > 1 and self.rows > 2 * len(self.held[0][0]):
            self.held = [self.merged(self.held)]
            self.rows = len(self.held[0][0])

    @staticmethod
    def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, n, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        firsts = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(firsts):
            return key, n, docs
        return key[firsts], np.add.reduceat(n[order], firsts), np.add.reduceat(docs[order], firsts)

    def full(self) -> bool:
        return self.rows > HELD or len(self.terms) > HELD

    def flush(self) -> Iterator[pa.RecordBatch]:
        """`lang`, `term`, `docs`, `n`, and `parts`: the sources with their counts."""
        if self.held:
            key, n, docs = self.merged(self.held)
            langs = np.array([lang for lang, _ in self.groups])
            names, lang_of = np.unique(langs, return_inverse=True)
            group, term = key >> 40, key & (1 << 40) - 1
            # A row for each language and term.
            order = np.lexsort((group, term, lang_of[group]))
            group, term, n, docs = group[order], term[order], n[order], docs[order]
            row = lang_of[group] * len(self.terms) + term
            firsts = np.flatnonzero(np.diff(row, prepend=-1))
            ends = np.append(firsts, len(row))
            sources = pa.array([s for _, s in self.groups], pa.string()).take(pa.array(group))
            parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([sources, pa.array(n)], ["source", "n"]))
            columns = [
                pa.array(names.tolist(), pa.string()).take(pa.array(lang_of[group[firsts]])),
                pa.array(list(self.terms), pa.string()).take(pa.array(term[firsts])),
                pa.array(np.add.reduceat(docs, firsts)), pa.array(np.add.reduceat(n, firsts)), parts,
            ]
            yield from pa.Table.from_arrays(columns, ["lang", "term", "docs", "n", "parts"]).to_batches(20_000)
        self.__init__()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often terms occur in groups, and in how many documents, in parts."""
    counts = Counts()
    for batch in batches:
        keys = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
        for start, stop in groups(batch.column("text")):
            counts.add(keys[start:stop], batch.column("text")[start:stop])
            if counts.full():
                yield from counts.flush()
    yield from counts.flush()


def share(count: Column, total: str, vocabulary: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + vocabulary)), of numbers beyond 64 bits for counts that have them."""
    wide = "decimal(20,0)"
    up, down = count + 1, F.col(total) + F.col(vocabulary)
    large = F.lit(UNIT).cast(wide) * up.cast(wide)
    # The remainder goes first, so that the quotient is whole.
    by_decimals = ((large - large % down.cast(wide)) / down.cast(wide)).cast("long")
    small = up * UNIT
    return F.when(count < (1 << 33), F.call_function("div", small, down)).otherwise(by_decimals) + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def intersections(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Number of terms in each set of `one` and each of `other`, sets as rows of words."""
    out = np.zeros((len(one), len(other)), np.int64)
    step = max(1, CELLS // max(1, other.size))
    for a in range(0, len(one), step):
        out[a : a + step] = np.bitwise_count(one[a : a + step, None] & other[None]).sum(axis=2, dtype=np.int64)
    return out


def cells(one: np.ndarray, other: np.ndarray, terms: int, common: np.ndarray) -> np.ndarray:
    """Number of terms by row of `one` and of `other`, from their intersections; row and column 0 are terms in none."""
    out = np.zeros((len(one) + 1, len(other) + 1), np.int64)
    out[1:, 1:] = common
    out[1:, 0] = np.bitwise_count(one).sum(axis=1, dtype=np.int64) - common.sum(axis=1)
    out[0, 1:] = np.bitwise_count(other).sum(axis=1, dtype=np.int64) - common.sum(axis=0)
    out[0, 0] = terms - out.sum()
    return out


def partial_sums(table: pa.Table) -> pa.Table:
    """For each two groups of a chunk's two blocks, the chunk's part of both their values."""
    columns = {c: table.column(c).combine_chunks() for c in ("source", "word", "n", "bits", "p", "terms", "block")}
    source = columns["source"].dictionary_encode()
    code = source.indices.to_numpy(zero_copy_only=False)
    word, n, bits, p, block = (columns[c].to_numpy(zero_copy_only=False) for c in ("word", "n", "bits", "p", "block"))
    terms = columns["terms"][0].as_py()
    order = np.lexsort((n, code))
    bounds = np.searchsorted(code[order], np.arange(len(source.dictionary) + 1))
    width = -(-terms // 64)
    sets, shares, blocks = [], [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = order[a:b]
        # Every group has a row of count 0, which has no word.
        counts, level = np.unique(n[own], return_inverse=True)
        found = np.zeros((len(counts), width), np.uint64)
        filled = level > 0
        found[level[filled], word[own][filled]] = bits[own][filled].astype(np.int64).view(np.uint64)
        at = np.zeros(len(counts), np.int64)
        at[level] = p[own]
        sets.append(found[1:])
        shares.append(at)
        blocks.append(block[own[0]])
    # A block may be empty, so the blocks that are met don't tell.
    one_block = table.column("one")[0].as_py() == table.column("two")[0].as_py()
    stacked, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    left, right, values = [], [], []
    for i in range(len(sets)):
        # All later groups at once.
        common = intersections(sets[i], stacked[at[i + 1] :])
        for j in range(i + 1, len(sets)):
            if not one_block and blocks[i] == blocks[j]:
                continue  # the blocks' own pairs are in other tasks
            joint = cells(sets[i], sets[j], terms, common[:, at[j] - at[i + 1] : at[j + 1] - at[i + 1]])
            a, b = shares[i][:, None], shares[j][None, :]
            left += [i, j]
            right += [j, i]
            values += [int((joint * apart(a, b)).sum()), int((joint * apart(b, a)).sum())]
    names, langs = source.dictionary, table.column("lang")[:1].combine_chunks().take(pa.array(np.zeros(len(left), np.int64)))
    return pa.table({"lang": langs, "source": names.take(pa.array(left, pa.int64())), "item": names.take(pa.array(right, pa.int64())), "value": pa.array(values, pa.int64())})


def audit(docs: DataFrame, least: int = 3, most_terms: int = 200, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """`lang`, `source`, `part`, `item`, `value`, `rank`: of each group the divergence from the other
    sources of its language (part `pair`), and its terms of higher share than in the language (part `term`, the first `most_terms`)."""
    named = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((text_column, "text"), (lang_column, "lang"), (source_column, "source"))])
    parts = named.mapInArrow(counted, "lang string, term string, docs long, n long, parts array<struct<source:string,n:long>>")
    # One shuffle, of a row per task, language and term; sums over languages and groups find their rows where they are.
    of_term = Window.partitionBy("lang", "term")
    frequent = (
        parts.repartition("lang", "term")
        .withColumns({"docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term)})
        .where(F.col("docs") >= least)
        .select("lang", "term", "lang_n", F.inline("parts"))
    )
    counts = settle(frequent.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.first("lang_n").alias("lang_n")))
    terms = settle(counts.select("lang", "term", "lang_n").distinct())
    # Small tables are settled, so that joins with them are planned from their size.
    langs = settle(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total")))
    chunks = F.ceil(F.col("terms") / CHUNK).cast("int")
    chunked = terms.join(langs, "lang").select("lang", "term", "lang_n", F.pmod(F.xxhash64("term"), chunks).cast("int").alias("chunk"))
    in_chunk = Window.partitionBy("lang", "chunk").orderBy("term")
    placed = chunked.withColumn("place", F.row_number().over(in_chunk) - 1)
    kept = settle(counts.drop("lang_n").join(placed, ["lang", "term"]))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    all_groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    all_groups = settle(all_groups)
    sources = settle(all_groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")))
    of_lang = all_groups.join(langs, "lang")

    pairs = summed_pairs(kept, of_lang.join(sources, "lang"))
    bare = all_groups.join(langs, "lang", "left_anti")
    zero = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    pairs = pairs.unionByName(zero.withColumn("value", F.lit(0).cast("long")))

    higher = (
        kept.join(of_lang, ["lang", "source"])
        .withColumn("p", share(F.col("n"), "total", "terms"))
        .withColumn("q", share(F.col("lang_n"), "lang_total", "terms"))
        .where("p > q")
        .select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [
        found.withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit(part))
        for part, found in (("pair", pairs), ("term", higher))
    ]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= most_terms)).select("lang", "source", "part", "item", "value", "rank")


def summed_pairs(kept: DataFrame, of_lang: DataFrame) -> DataFrame:
    """`lang`, `source`, `item` and `value` of each two sources of a language that keeps terms."""
    words = (
        kept.withColumn("word", F.floor(F.col("place") / 64).cast("int"))
        .groupBy("lang", "chunk", "source", "n", "word")
        .agg(F.expr("bit_or(shiftleft(1L, place % 64))").alias("bits"))
    )
    numbers = F.explode(F.sequence(F.lit(0), F.ceil(F.col("terms") / CHUNK).cast("int") - 1))
    # Places are numbered without gaps.
    sizes = kept.groupBy("lang", "chunk").agg((F.max("place") + 1).cast("long").alias("in_chunk"))
    none = of_lang.select("lang", "source", numbers.alias("chunk")).withColumns({"n": F.lit(0).cast("long"), "word": F.lit(0), "bits": F.lit(0).cast("long")})
    rows = words.select(none.columns).unionByName(none).join(of_lang, ["lang", "source"]).join(settle(sizes), ["lang", "chunk"])
    blocks = F.ceil(F.col("sources") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("source"), blocks).cast("int")
    units = rows.select(
        "lang", "chunk", "source", "n", "word", "bits", share(F.col("n"), "total", "terms").alias("p"),
        F.col("in_chunk").alias("terms"), block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"),
    ).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    found = units.groupBy("lang", "chunk", "one", "two").applyInArrow(partial_sums, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
