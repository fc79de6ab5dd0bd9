"""MinHash fingerprints of documents, and what they tell about two texts.

A text's shingles are its runs of five words, A-Z counted as a-z; a text of fewer words is one shingle.
Universal hash functions, x -> a * x + b modulo 2 ** 64 with odd a, permute the shingles' 64-bit hashes; the fingerprint
keeps 16 bits of each permutation's least value, its halves XORed, for all texts of a batch in a few array operations.
The likeness of two fingerprints is the share of their numbers that are equal, an estimate of the
Jaccard similarity of the two sets of shingles.

`classes` finds the similar texts of a table: bands of the fingerprint's numbers are joined in Spark, and
pairs that share one are links if their shingle sets, compared in full, have a Jaccard similarity of 0.8 or more.

`against_next` holds each document against the one that follows it in the descending order of ids, and against a
text made of both: the document with its last half, in code points, replaced by the next one's first. One
range shuffle puts the documents in order; a task keeps two texts at a time and compares neighbours as they stream through, and of
each partition its first and last text are written as well, so that the neighbours across
two partitions meet in a join with a row per partition. `bands_...` counts the shared bands, and `jaccard_...` is the exact
similarity of the shingle sets beside the estimate `near_...`.

Null and empty texts are equal; all texts without words have the same fingerprint, which is like no other. Equal texts have equal fingerprints.
Null ids come last; rows of equal id are separate documents, in the order of their texts' hashes. A
table of one row is its own next. An empty table gives an empty one. Columns other than id and text don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.common import mixed
from logloom.llm.near_dups import NearDuplicates, without_counts
from logloom.llm.tokens import groups
from logloom.llm.words import hashes, windows, words_of
from logloom.session import settle

SHINGLE = 5
BANDS, ROWS = 25, 5
PERMUTATIONS = BANDS * ROWS
#: Shingles that go through all permutations together: few enough for a processor's cache.
STEP = 1 << 15
#: What a text without words has for each permutation.
NOTHING = np.uint16(0xFFFF)

with np.errstate(over="ignore"):
    _draws = mixed(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
MULTIPLIERS, SHIFTS = _draws[:PERMUTATIONS] | np.uint64(1), _draws[PERMUTATIONS:]


def shingles_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct shingle, in the order of both."""
    words = words_of(texts)
    own, text = hashes(words.data, words.starts, words.ends), words.texts()
    counts = np.diff(words.firsts)
    found = windows(own, SHINGLE)
    whole = np.arange(len(own)) + SHINGLE <= words.firsts[1:][text]
    short = words.firsts[:-1][(counts > 0) & (counts < SHINGLE)]
    for first in short.tolist():
        found[first] = windows(own[first : words.firsts[text[first] + 1]], SHINGLE)[0]
    whole[short] = True
    text, found = text[whole], found[whole]
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    return text[new], found[new]


def signatures(text: np.ndarray, shingle: np.ndarray, texts: int) -> np.ndarray:
    """The fingerprint of each text, a row of 16-bit numbers."""
    out = np.full((texts, PERMUTATIONS), 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(shingle), STEP):
            own, values = text[start : start + STEP], shingle[start : start + STEP]
            firsts = np.flatnonzero(np.diff(own, prepend=-1))
            rows = own[firsts]
            for k in range(PERMUTATIONS):
                least = np.minimum.reduceat(values * MULTIPLIERS[k] + SHIFTS[k], firsts)
                out[rows, k] = np.minimum(out[rows, k], least)
    folded = (out ^ (out >> np.uint64(32))).astype(np.uint16)
    folded[np.bincount(text, minlength=texts) == 0] = NOTHING
    return folded


def as_bytes(prints: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in prints.astype("<u2")], pa.binary())


def likeness(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of equal numbers and count of equal bands, of each two fingerprints in equal rows."""
    equal = one == other
    empty, empty_too = (one == NOTHING).all(axis=1), (other == NOTHING).all(axis=1)
    equal[empty != empty_too] = False
    return equal.mean(axis=1), equal.reshape(len(equal), BANDS, ROWS).all(axis=2).sum(axis=1)


def jaccard(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], texts: int) -> np.ndarray:
    """Exact similarity of each two shingle sets in equal rows; of two empty sets it is 1."""
    sizes = np.bincount(one[0], minlength=texts) + np.bincount(other[0], minlength=texts)
    text, shingle = (np.concatenate(x) for x in zip(one, other, strict=True))
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    twice = (text[1:] == text[:-1]) & (shingle[1:] == shingle[:-1])
    common = np.bincount(text[1:][twice], minlength=texts)
    return np.where(sizes > 0, common / np.maximum(sizes - common, 1), 1.0)


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`registers`, the fingerprint, in place of `text`; null where a text has no words. There are no weights."""
    for batch in batches:
        others = [c for c in batch.schema.names if c != "text"]
        for start, stop in groups(batch.column("text")):
            part = batch.slice(start, stop - start)
            found = signatures(*shingles_of(part.column("text")), len(part))
            empty = (found == NOTHING).all(axis=1)
            # The bands of `NearDuplicates` are cut from 32-bit numbers.
            column = pa.array([r.tobytes() for r in found.astype("<u4")], pa.binary(), mask=empty)
            columns = [*[part.column(c) for c in others], column, pa.nulls(len(part), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*others, "registers", "weighted"])


class Fingerprinted(NearDuplicates):
    """Similar texts by bands of fingerprints."""

    sketch = staticmethod(sketched)
    measured = staticmethod(without_counts)


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`id_column`, `class_id`, the smallest id of the row's class of similar texts, and `class_size`, in rows."""
    return Fingerprinted(docs, id_column, text_column).classes()


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`id_column` and `fingerprint`, the numbers in order, 16 bits each, little endian."""
    chosen = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in groups(batch.column("text")):
                found = signatures(*shingles_of(batch.column("text")[start:stop]), stop - start)
                yield pa.RecordBatch.from_arrays([batch.column("id")[start:stop], as_bytes(found)], ["id", "fingerprint"])

    found = chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, fingerprint binary")
    return found.withColumnRenamed("id", id_column)


COMPARED = (
    "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double,"
    " bands_edited int, bands_next int, jaccard_edited double, jaccard_next double"
)


def edited(text: str, following: str) -> str:
    """`text` with its last half replaced by the first code points of another one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(texts: list[str]) -> dict[str, pa.Array]:
    """The columns of COMPARED for each text but the last, against the text behind it."""
    n = len(texts) - 1
    mixtures = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    own = shingles_of(pa.array(texts, pa.string()))
    made = shingles_of(pa.array(mixtures, pa.string()))
    prints, made_prints = signatures(*own, n + 1), signatures(*made, n)
    near_edited, bands_edited = likeness(prints[:n], made_prints)
    near_next, bands_next = likeness(prints[:n], prints[1:])
    cut, skip = np.searchsorted(own[0], [n, 1])
    all_but_last, all_but_first = (own[0][:cut], own[1][:cut]), (own[0][skip:] - 1, own[1][skip:])
    return {
        "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in mixtures]),
        "fingerprint": as_bytes(prints[:n]), "edited_fingerprint": as_bytes(made_prints),
        "near_edited": pa.array(near_edited), "near_next": pa.array(near_next),
        "bands_edited": pa.array(bands_edited, pa.int32()), "bands_next": pa.array(bands_next, pa.int32()),
        "jaccard_edited": pa.array(jaccard(all_but_last, made, n)), "jaccard_next": pa.array(jaccard(all_but_last, all_but_first, n)),
    }


def row_batch(schema: pa.Schema, rows: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The columns in the order of `schema`, null where there is none."""
    found = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(found, schema=schema)


def against_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`id_column` and the columns of COMPARED, for every document."""
    chosen = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    kind = dict(chosen.dtypes)["id"]
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    ordered = chosen.repartitionByRange(*order).sortWithinPartitions(*order)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, schema, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            keys = batch.column("id")
            for start, stop in groups(batch.column("text")):
                ids, texts = keys[start:stop], batch.column("text")[start:stop].to_pylist()
                if last is None:
                    schema = pa.schema([("id", keys.type), *arrow_fields(COMPARED), ("part", pa.int64()), ("edge", pa.string()), ("text", pa.string())])
                    yield row_batch(schema, 1, {"part": pa.array([part]), "edge": pa.array(["first"]), "text": pa.array(texts[:1])})
                else:
                    ids, texts = pa.concat_arrays([last[0], ids]), [last[1], *texts]
                if len(texts) > 1:
                    yield row_batch(schema, len(texts) - 1, {"id": ids[:-1], **compared(texts)})
                last = ids[-1:], texts[-1]
        if last is not None:
            yield row_batch(schema, 1, {"id": last[0], "part": pa.array([part]), "edge": pa.array(["last"]), "text": pa.array([last[1]])})

    # Settled: a task that runs again must not deal the order of equal rows anew between edges and rows.
    found = settle(ordered.mapInArrow(stream, f"id {kind}, {COMPARED}, part long, edge string, text string"))
    firsts, lasts = (found.where(F.col("edge") == edge) for edge in ("first", "last"))
    # One row per partition that has rows; the last one goes on at the first.
    parts = firsts.select("part")
    by_part = Window.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy())).alias("next_part"))
    across = (
        lasts.select("id", "part", "text").join(after, "part")
        .join(firsts.select(F.col("part").alias("next_part"), F.col("text").alias("next_text")), "next_part")
        .select("id", "text", "next_text")
    )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                columns = compared([batch.column(c)[i].as_py() for c in ("text", "next_text")])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1), *columns.values()], ["id", *columns])

    inner = found.where("edge IS NULL").drop("part", "edge", "text")
    whole = inner.unionByName(across.mapInArrow(pairs, f"id {kind}, {COMPARED}"))
    return whole.withColumnRenamed("id", id_column)


def arrow_fields(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32()}
    return [(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(","))]


def as_text(fingerprint: Column) -> Column:
    """The numbers as hexadecimal digits."""
    return F.lower(F.hex(fingerprint))
