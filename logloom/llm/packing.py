"""Documents packed into training sequences by the sum-of-squares rule.

Every input partition is packed by its own task as it streams through, so nothing is shuffled.
A document's ids are cut into full sequences and a rest; the rest goes whole to the fill level
(or a new sequence) that leaves the smallest sum of squared counts of partly filled sequences,
counts that an array by level tracks. At the end of a partition its partly filled sequences are
emptied into one another by cuts, and the last one is cut into sequences of powers of two, which
need no padding. Ids of a document stay in the task until its sequence is full.

Packing depends on how the input is split, like any packing in parallel; pieces and sequences
are settled before they are numbered, so a task that runs again changes nothing.

Null texts are empty; an empty text is its end id alone. Rows of equal or null id are separate
documents. Ids may be of any type that Arrow has; no other column is looked at. An empty table
gives no pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.tokens import encoded, encoder_for
from logloom.session import settle

#: A piece of a document in a sequence: row, start in the document, ids.
Piece = tuple[int, int, np.ndarray]


class SumOfSquares:
    """Open sequences by fill level, for items of at most `size` tokens."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)  # partly filled sequences by fill level
        self.open: dict[int, list[list[Piece]]] = {}

    def level_for(self, n: int) -> int:
        """The level, 0 for a new sequence, that an item of n tokens goes to."""
        levels = np.flatnonzero(self.counts[: self.size - n + 1])
        if not len(levels):
            return 0
        after = self.counts[levels + n]
        # Moving one sequence from a to b changes the sum by 2 (count b - count a + 1), or by
        # 1 - 2 count a if b is full and no longer counts; a new one adds 2 count n + 1.
        change = np.where(levels + n < self.size, 2 * (after - self.counts[levels]) + 2, 1 - 2 * self.counts[levels])
        best = len(change) - 1 - int(np.argmin(change[::-1]))  # the fullest of equals
        return int(levels[best]) if change[best] <= 2 * self.counts[n] + 1 else 0

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece somewhere; the sequence if that filled it."""
        n = len(piece[2])
        level = self.level_for(n)
        if level:
            stack = self.open[level]
            sequence = stack.pop()
            if not stack:
                del self.open[level]
            self.counts[level] -= 1
        else:
            sequence = []
        sequence.append(piece)
        if level + n == self.size:
            return sequence
        self.counts[level + n] += 1
        self.open.setdefault(level + n, []).append(sequence)
        return None

    def rest(self) -> Iterator[list[Piece]]:
        """The open sequences, filled up from the emptiest ones; the last in powers of two."""
        left = deque(s for level in sorted(self.open) for s in self.open[level])
        self.open, pool = {}, deque()  # pool: pieces of sequences that were given up
        while left:
            sequence = left.pop()
            space = self.size - sum(len(p[2]) for p in sequence)
            while space and (pool or left):
                if not pool:
                    pool.extend(left.popleft())
                row, start, ids = pool.popleft()
                sequence.append((row, start, ids[:space]))
                if len(ids) > space:
                    pool.appendleft((row, start + space, ids[space:]))
                space -= min(space, len(ids))
            if not space:
                yield sequence
            else:
                pool.extend(sequence)
        while pool:
            # The most that fits of a full sequence or, for the last ids, a power of two.
            total = sum(len(p[2]) for p in pool)
            space = self.size if total >= self.size else 1 << (total.bit_length() - 1)
            sequence = []
            while space:
                row, start, ids = pool.popleft()
                sequence.append((row, start, ids[:space]))
                if len(ids) > space:
                    pool.appendleft((row, start + space, ids[space:]))
                space -= min(space, len(ids))
            yield sequence


def packed(documents: Iterator[tuple[int, np.ndarray]], size: int) -> Iterator[list[Piece]]:
    """Sequences of documents given as (row, ids)."""
    packer = SumOfSquares(size)
    for row, ids in documents:
        whole = len(ids) - len(ids) % size
        for start in range(0, whole, size):
            yield [(row, start, ids[start : start + size])]
        if whole < len(ids) and (sequence := packer.place((row, whole, ids[whole:].copy()))):
            yield sequence
    yield from packer.rest()


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    size: int = 4096,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces: the id, `start`, `length`, `token_ids` (unsigned 32-bit, little endian),
    `doc_tokens`, `offset` in the sequence, and `part` and `local_id` of the sequence."""
    chosen = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    kind = dict(chosen.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = encoder_for(vocabulary, end_id)
        names: dict[int, tuple] = {}  # of rows that have ids in open sequences: id, tokens, tokens left

        def documents() -> Iterator[tuple[int, np.ndarray]]:
            row = 0
            for batch in batches:
                keys = batch.column("doc_id")
                for first, stop, ids, bounds in encoded(batch.column("text"), encoder):
                    for i in range(first, stop):
                        own = ids[bounds[i - first] : bounds[i - first + 1]]
                        names[row] = [keys[i], len(own), len(own)]
                        yield row, own
                        row += 1

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([k.as_py() for k in columns[0]], schema_id), *[pa.array(c, pa.int64()) for c in columns[1:4]], pa.array(columns[4], pa.binary()), *[pa.array(c, pa.int64()) for c in columns[5:]]],
                ["doc_id", "start", "length", "doc_tokens", "token_ids", "part", "local_id", "offset"],
            )

        rows, held, schema_id = [], 0, None
        for number, sequence in enumerate(packed(documents(), size)):
            offset = 0
            for row, start, ids in sequence:
                name = names[row]
                schema_id = name[0].type
                rows.append((name[0], start, len(ids), name[1], ids.astype("<u4").tobytes(), part, number, offset))
                offset += len(ids)
                name[2] -= len(ids)
                if not name[2]:
                    del names[row]
            held += offset
            if held >= 1 << 20:
                yield flush(rows)
                rows, held = [], 0
        if rows:
            yield flush(rows)

    return chosen.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, token_ids binary, part long, local_id long, offset long")


def with_crc(pieces: DataFrame) -> DataFrame:
    """`pieces` with `ids_crc32` in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("token_ids")).drop("token_ids")


def numbered(pieces: DataFrame) -> DataFrame:
    """`pieces`, settled, with `sequence_id` 0, 1, ... instead of `part` and `local_id`."""
    pieces = settle(pieces)
    # One row per partition of the input.
    counts = pieces.groupBy("part").agg((F.max("local_id") + 1).alias("sequences"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("sequences").over(before), F.lit(0)).alias("first_id"))
    return (
        pieces.join(F.broadcast(starts), "part")
        .withColumn("sequence_id", F.col("first_id") + F.col("local_id"))
        .drop("part", "local_id", "first_id")
    )
