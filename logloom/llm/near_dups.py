"""Near-duplicate texts by ProbMinHash over weighted word shingles.

Shingles are runs of five words (all words of a shorter text), of weight 1 + ln(count). Each shingle is a Poisson
process whose arrivals, of a rate in proportion to the weight, visit the registers in an order of the shingle's own
without repetition; a register keeps the first arrival. A shingle ends as soon as its next arrival is later than all
that its text's registers hold. Equal registers of two texts are as frequent as their probability Jaccard similarity.

Two texts are linked if either of two exact measures is 0.8 or more: the probability Jaccard similarity of the
weights, or the Jaccard similarity of the sets, which is the same measure with all weights 1. Texts that repeat what they share
unequally can have few weighted registers in common, so a text with repeated shingles has a second row of registers, with weights of 1;
without repeats both rows are one. Bands of the registers make buckets, and a text is in those of both rows.

Equal texts are one node from the start. First, every member of a
bucket is compared with its leader, the member that has most company in all its buckets: of those leaders
with which at least MAYBE of the registers of one row agree, the best one's shingles are compared. That joins copies in thousands by
one comparison each. A bucket whose members are one component by then is done. In all others the members outside the bucket's largest component
are compared with all members of other components, in blocks, by a matrix product over their shingles and by their registers;
pairs that only the registers suggest are measured in the block, until one joins its two components. A block gives links, no pairs, and all
its links are exact, so no link between texts that share a bucket is left out. A block has BLOCK members or BLOCK_SHINGLES shingles on average, whichever
is less. What is written for a bucket grows with its members times the blocks of those outside its largest component: a bucket of
many components that are not alike costs the square of its blocks, never of its members in rows.

With 25 bands of five registers a pair of similarity 0.8 shares a bucket with probability 0.9999, by the measure that is 0.8.

Results: one row per row of the input. Null and empty texts are equal texts; other texts
without words are like their equals only. Rows of equal id and different texts are different documents.
A class's id is null only if all its ids are. Columns of the input other than id and text don't matter. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import carried, double_hash, mixed
from logloom.llm.components import components
from logloom.llm.tokens import groups
from logloom.llm.words import hashes, windows, words_of
from logloom.session import settle

SHINGLE = 5
SIMILAR = 0.8
REGISTERS = 127  # a prime, so that steps of any width visit all of them
BANDS, ROWS = 25, 5
MAYBE = 0.6  # over five standard deviations below SIMILAR
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20  # members of a bucket, and their shingles, that are compared with each other or another block at once
COLUMNS = 4096  # shingles in a step of the matrix product


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each distinct shingle, in the order of both."""
    words = words_of(texts)
    own = hashes(words.data, words.starts, words.ends)
    text = words.texts()
    last = words.firsts[1:][text]
    place = np.arange(len(own))
    found = windows(own, SHINGLE)
    whole = place + SHINGLE <= last
    # The whole of a text of fewer words.
    for i in np.flatnonzero((np.diff(words.firsts) > 0) & (np.diff(words.firsts) < SHINGLE)):
        first, stop = words.firsts[i], words.firsts[i + 1]
        found[first] = windows(own[first:stop], SHINGLE)[0]
        whole[first] = True
    text, found = text[whole], found[whole]
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], found[at], np.diff(np.append(at, len(found)))


def signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
    """Registers of each text: the lower 32 bits of the shingle whose arrival was first."""
    first = np.full(texts * REGISTERS, np.inf)
    owner = np.zeros(texts * REGISTERS, np.uint32)
    weight = 1.0 + np.log(count)
    order = mixed(shingle ^ np.uint64(0x5851F42D4C957F2D))
    register = (order % np.uint64(REGISTERS)).astype(np.int64)
    step = 1 + ((order >> np.uint64(32)) % np.uint64(REGISTERS - 1)).astype(np.int64)
    time = np.zeros(len(shingle))
    for k in range(REGISTERS):
        if not len(shingle):
            break
        draw = mixed(shingle + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        # Without repetition, the k-th arrival comes to one of the registers that are left.
        time = time - np.log(uniform) / weight * (REGISTERS / (REGISTERS - k))
        at = text * REGISTERS + register
        np.minimum.at(first, at, time)
        won = first[at] == time
        owner[at[won]] = shingle[won].astype(np.uint32)
        latest = first.reshape(texts, REGISTERS).max(axis=1)
        go = time < latest[text]
        text, shingle, weight, time, step = text[go], shingle[go], weight[go], time[go], step[go]
        register = (register[go] + step) % REGISTERS
    return owner.reshape(texts, REGISTERS)


def registers_of(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Registers of each text with weights of 1 and with its weights, and whether it has repeated shingles."""
    plain = signatures(text, shingle, np.ones_like(count), texts)
    repeats = np.zeros(texts, bool)
    repeats[text[count > 1]] = True
    weighted, own = plain.copy(), repeats[text]
    if own.any():
        number = np.cumsum(repeats) - 1
        weighted[repeats] = signatures(number[text[own]], shingle[own], count[own], int(repeats.sum()))
    return plain, weighted, repeats


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`registers` and, of texts with repeated shingles, `weighted` in place of `text`; null where a text has no words."""
    for batch in batches:
        others = [c for c in batch.schema.names if c != "text"]
        for start, stop in groups(batch.column("text")):
            part = batch.slice(start, stop - start)
            text, shingle, count = shingles(part.column("text"))
            plain, weighted, repeats = registers_of(text, shingle, count, len(part))
            empty = np.ones(len(part), bool)
            empty[text] = False
            rows = [as_bytes(plain, empty), as_bytes(weighted, ~repeats)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], *rows], [*others, "registers", "weighted"])


def as_bytes(rows: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows.astype("<u4")], pa.binary(), mask=null)


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`n`, the number of distinct shingles, `shingles`, their sorted hashes, and `counts`, null if all are 1, in place of `text`."""
    for batch in batches:
        for start, stop in groups(batch.column("text")):
            part = batch.slice(start, stop - start)
            text, shingle, count = shingles(part.column("text"))
            bounds = np.searchsorted(text, np.arange(len(part) + 1))
            cut = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            counts = [c.astype("<u4").tobytes() if (c := count[a:b]).max(initial=1) > 1 else None for a, b in cut]
            whole = pa.array([shingle[a:b].astype("<u8").tobytes() for a, b in cut], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.array(np.diff(bounds), pa.int64()), whole, pa.array(counts, pa.binary())], ["node", "n", "shingles", "counts"]
            )


def without_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`shingle_sets` with all shingles of weight 1."""
    for part in shingle_sets(batches):
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.nulls(len(part), pa.binary())], part.schema.names)


#: A text's sorted shingles and their counts, or None for counts of 1.
Weighted = tuple[np.ndarray, np.ndarray | None]


def weighted_sets(shingles: pa.Array, counts: pa.Array) -> list[Weighted]:
    return [(np.frombuffer(x, "<u8"), None if c is None else np.frombuffer(c, "<u4")) for x, c in zip(shingles.to_pylist(), counts.to_pylist(), strict=True)]


def probability_jaccard(one: Weighted, other: Weighted) -> float:
    """The sum, over common shingles i, of 1 / sum over all j of max(a_j / a_i, b_j / b_i)."""
    union = np.union1d(one[0], other[0])
    a, b = np.zeros(len(union)), np.zeros(len(union))
    for weights, (own, counts) in ((a, one), (b, other)):
        weights[np.searchsorted(union, own)] = 1.0 if counts is None else 1.0 + np.log(counts)
    with np.errstate(divide="ignore"):
        order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    # In the order of a / b, the maximum is b_j / b_i before i and a_j / a_i from i on.
    before = np.cumsum(b) - b
    behind = np.cumsum(a[::-1])[::-1]
    both = (a > 0) & (b > 0)
    return float((1 / (behind[both] / a[both] + before[both] / b[both])).sum())


def alike(one: Weighted, other: Weighted) -> bool:
    """Whether one of the two measures is large enough."""
    x, y = one[0], other[0]
    if not (len(x) and len(y)):
        return False
    if min(len(x), len(y)) >= SIMILAR * max(len(x), len(y)):
        # |A and B| / |A or B| >= 4 / 5, in whole numbers.
        common = len(np.intersect1d(x, y, assume_unique=True))
        if 5 * common >= 4 * (len(x) + len(y) - common):
            return True
    return not (one[1] is None and other[1] is None) and probability_jaccard(one, other) >= SIMILAR - 1e-9


def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose registers of one row agree often enough, with the share that does."""
    for batch in batches:
        if not len(batch):
            continue
        shares = []
        for row in ("registers", "sketch"):
            a, b = (np.stack([np.frombuffer(x, "<u4") for x in batch.column(f"{row}_{side}").to_pylist()]) for side in "ab")
            shares.append((a == b).mean(axis=1))
        share = np.maximum(*shares)
        near = pa.array(share >= MAYBE)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near), pa.array(share).filter(near)], ["a", "b", "share"])


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that are links."""
    for batch in batches:
        one, other = (weighted_sets(batch.column(f"shingles_{side}"), batch.column(f"counts_{side}")) for side in "ab")
        keep = pa.array([alike(x, y) for x, y in zip(one, other, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def both_sides(pairs: DataFrame, table: DataFrame, *values: str) -> DataFrame:
    """`pairs` (a, b) with the values of each side's node."""
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("node").alias(side), *[F.col(v).alias(f"{v}_{side}") for v in values]), side)
    return pairs


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # of values that two sets have
    kept = times[code] > 1
    owner, code = owner[kept], number[code[kept]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [first, first + COLUMNS])
        ones = np.zeros((len(sets), min(COLUMNS, int(code[-1]) + 1 - first)), np.float32)
        ones[owner[a:b], code[a:b] - first] = 1
        out += ones @ ones.T
    return out


def joining(table: pa.Table) -> pa.Table:
    """Links (a, b) between members of a block, or of two, that join their components (roots)."""
    node, root, block = (table.column(c).to_numpy() for c in ("node", "root", "block"))
    sets = weighted_sets(table.column("shingles"), table.column("counts"))
    size = np.array([len(x) for x, _ in sets], np.float32)
    common = shared_counts([x for x, _ in sets])
    near = 5 * common >= 4 * (size[:, None] + size - common)
    open_pairs = root[:, None] != root
    if (block != block[0]).any():
        open_pairs &= block[:, None] != block  # the blocks' own pairs are compared elsewhere
    near &= open_pairs
    sketch = np.stack([np.frombuffer(x, "<u4") for x in table.column("sketch").to_pylist()])
    maybe = np.zeros_like(near)
    for i in np.flatnonzero([c is not None for _, c in sets]):
        maybe[i] = (sketch[i] == sketch).mean(axis=1) >= MAYBE
    maybe = (maybe | maybe.T) & open_pairs & ~near
    names, code = np.unique(root, return_inverse=True)
    parent = list(range(len(names)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    a, b = np.nonzero(np.triu(near, 1))
    # One pair of each two components will do, as all of these are links.
    low, high = np.minimum(code[a], code[b]), np.maximum(code[a], code[b])
    _, first = np.unique(low.astype(np.int64) * len(names) + high, return_index=True)
    a, b = np.concatenate([a[first], (more := np.nonzero(np.triu(maybe, 1)))[0]]), np.concatenate([b[first], more[1]])
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(int(code[i])), top(int(code[j]))
        if x != y and (near[i, j] or alike(sets[i], sets[j])):
            parent[y] = x
            links.append((node[i], node[j]))
    left, right = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


class NearDuplicates:
    """The tables of one run, each written to the shared folder once."""

    #: Makes `registers` and `weighted` of texts, on which the bands are taken.
    sketch = staticmethod(sketched)
    #: Makes the shingles and counts that are measured.
    measured = staticmethod(shingle_sets)

    def __init__(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"):
        self.names, self.id_column = docs.columns, id_column
        text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
        h1, h2 = double_hash(text)
        self.keyed = carried(docs, id=F.col(f"`{id_column}`"), text=text, h1=h1, h2=h2)
        # Equal texts are one node; any row's registers will do for it.
        self.nodes = settle(
            self.keyed.select("h1", "h2", "text")
            .mapInArrow(self.sketch, "h1 long, h2 long, registers binary, weighted binary")
            .groupBy("h1", "h2")
            .agg(F.first("registers").alias("registers"), F.first("weighted").alias("weighted"))
            .withColumns({"node": F.monotonically_increasing_id(), "sketch": F.coalesce("weighted", "registers")})
        )

    def members(self) -> DataFrame:
        """`band`, `key`, `node`, with `size` and `leader`, of buckets of two nodes or more."""
        width = 4 * ROWS

        def band(row: str, b: int) -> Column:
            return F.substring(row, width * b + 1, width)

        def key(row: str, b: int) -> Column:
            return F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), band(row, b)).alias("key"))

        # A text without repeats has one row of registers; a band that is equal in both is one bucket.
        other = [F.when(band("weighted", b) != band("registers", b), key("weighted", b)) for b in range(BANDS)]
        keys = F.array_compact(F.array(*[key("registers", b) for b in range(BANDS)], *other))
        known = self.nodes.where("registers IS NOT NULL")
        all_members = known.select("node", F.explode(keys).alias("at")).select("at.band", "at.key", "node")
        sizes = settle(all_members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        shared = settle(all_members.join(sizes, ["band", "key"]))
        company = shared.groupBy("node").agg(F.sum("size").alias("company"))
        leaders = settle(
            shared.join(company, "node")
            .groupBy("band", "key")
            .agg(F.max(F.struct("company", (-F.col("node")).alias("node"))).alias("top"))
            .select("band", "key", (-F.col("top.node")).alias("leader"))
        )
        return settle(shared.join(leaders, ["band", "key"]))

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """`node`, `n`, `shingles` and `counts`; texts go through one shuffle, equal ones once per task."""
        where = self.nodes.select("h1", "h2", "node").join(nodes, "node")
        texts = self.keyed.select("h1", "h2", "text").dropDuplicates(["h1", "h2"]).join(where, ["h1", "h2"])
        return settle(texts.select("node", "text").mapInArrow(self.measured, "node long, n long, shingles binary, counts binary"))

    def near(self, pairs: DataFrame) -> DataFrame:
        """`a`, `b` and `share` of the pairs that may be similar."""
        sides = both_sides(pairs, self.nodes, "registers", "sketch")
        return sides.mapInArrow(agreeing, "a long, b long, share double")

    def similar(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that are links."""
        return both_sides(pairs, sets, "shingles", "counts").mapInArrow(verified, "a long, b long")

    def roots(self) -> DataFrame:
        """`node` and `root` of the nodes that have links and aren't the root themselves."""
        members = self.members()
        sets = self.sets_of(members.select("node").distinct())
        led = members.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
        best = self.near(led).groupBy("b").agg(F.max(F.struct("share", (-F.col("a")).alias("a"))).alias("best"))
        links = settle(self.similar(best.select((-F.col("best.a")).alias("a"), "b"), sets))
        rooted = members.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        ends = rooted.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        rest = settle(rooted.join(ends.where("low < high").select("band", "key"), ["band", "key"]).join(sets.select("node", "n"), "node"))
        return components(links.unionByName(self.between(rest, sets)))

    def between(self, rest: DataFrame, sets: DataFrame) -> DataFrame:
        """Links that join components of the open buckets' members."""
        bucket = ["band", "key"]
        parts = rest.groupBy(*bucket, "root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
        home = settle(parts.groupBy(*bucket).agg(
            F.max(F.struct("members", (-F.col("root")).alias("root"), "shingles")).alias("home"),
            F.sum("members").alias("members"), F.sum("shingles").alias("shingles"),
        ))

        def blocks(members: Column, shingles: Column) -> Column:
            return F.ceil(F.greatest(members / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")

        inner, outer = F.col("home.members"), F.col("members") - F.col("home.members")
        counted = home.select(
            *bucket, (-F.col("home.root")).alias("home"), blocks(inner, F.col("home.shingles")).alias("inner"),
            blocks(outer, F.col("shingles") - F.col("home.shingles")).alias("outer"),
        )
        # Outsiders' blocks come first and meet all blocks; those of the largest component meet outsiders only.
        outside = F.col("root") != F.col("home")
        spread = F.xxhash64("node")
        block = F.when(outside, F.pmod(spread, F.col("outer"))).otherwise(F.col("outer") + F.pmod(spread, F.col("inner"))).cast("int")
        last = F.when(outside, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1
        units = rest.join(counted, bucket).select(
            *bucket, "node", "root", block.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other")
        )
        work = (
            units.select(*bucket, F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "root", "block")
            .join(sets.select("node", "shingles", "counts"), "node")
            .join(self.nodes.select("node", "sketch"), "node")
        )
        return work.groupBy(*bucket, "one", "two").applyInArrow(joining, "a long, b long").distinct()

    def rows(self) -> DataFrame:
        """The keyed rows with `root`, of rows' ids and keys only."""
        rooted = self.nodes.select("h1", "h2", "node").join(self.roots(), "node", "left")
        return self.keyed.select("id", "h1", "h2").join(
            rooted.select("h1", "h2", F.coalesce("root", "node").alias("root")), ["h1", "h2"]
        )


    def classes(self) -> DataFrame:
        """The id, `class_id`, the smallest id of the row's class, and `class_size`, in rows."""
        rows = settle(self.rows())
        # Settled, so that the join is planned from its size, or splits the rows of a large class.
        groups_of = settle(rows.groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")))
        return rows.join(groups_of, "root").select(F.col("id").alias(self.id_column), "class_id", "class_size")


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`id_column`, `class_id`, the smallest id of the row's class, and `class_size`, in rows."""
    return NearDuplicates(docs, id_column, text_column).classes()


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of `docs` for each class: of the smallest id, of whose rows the first text in hash order."""
    run = NearDuplicates(docs, id_column, text_column)
    order = F.struct(F.col("id").isNull().alias("late"), F.col("id"), F.col("h1"), F.col("h2"))
    best = run.rows().groupBy("root").agg(F.min(order).alias("best")).select("best.id", "best.h1", "best.h2")
    same = (run.keyed["id"].eqNullSafe(best["id"])) & (run.keyed["h1"] == best["h1"]) & (run.keyed["h2"] == best["h2"])
    kept = run.keyed.join(best, same, "left_semi").dropDuplicates(["id", "h1", "h2"])
    return kept.select(*[kept["row"].getField(c).alias(c) for c in run.names])
