"""Token ids in binary files: Simple-8b words with block offsets.

A 64-bit word has a selector in its upper four bits, which says how many ids of how many bits
the lower 60 hold. Ids go in blocks of BLOCK; a block takes as many ids as fit into each word in
turn, all blocks of a record at once. Ids of 60 bits or more, or that are the escape's own value,
are stored whole behind the words, and their place in a word has the escape. Because each block's
first word is known, all words of a record are decoded at once, by selector.

A file is a run of records, each complete in itself (all numbers are little endian):

    MAGIC, then six unsigned 64-bit numbers: bytes behind the header, documents, ids, words, escapes, crc32 of those bytes
    documents x signed 64-bit id, documents x one byte (1: the id is null), documents x unsigned 64-bit count of ids
    blocks x unsigned 64-bit offset of the block's first word
    words x unsigned 64-bit, escapes x unsigned 64-bit

Documents are shuffled by ranges of their id; each task writes one file by the file system of the
shared folder, under a name of its own, and reports it. Only reported files count, so a
task that runs again leaves no trace. Reading gives one task per file and one record at a time.

Null texts are empty; an empty text is the end id alone. Null ids come first. Rows of equal id are
separate documents, in the order of their texts' hash. Other columns are not written. An empty table gives
no files, and reading none gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.tokens import encoded, encoder_for
from logloom.session import settle, shared_folder

MAGIC = b"s8b-ids1"
HEADER = struct.Struct("<8s6Q")
BLOCK = 1024
#: Ids in a word and bits of each, by selector.
LAYOUT = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = np.uint64((1 << 60) - 1)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    out = np.zeros(values.shape, np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        high = values >= np.uint64(1 << shift)
        out[high] += shift
        values = np.where(high, values >> np.uint64(shift), values)
    return out + (values > 0).astype(np.uint8)


def compress(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block, and escaped values."""
    values = np.ascontiguousarray(values, np.uint64)
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    escaped = values[values >= ESCAPE]
    blocks = -(-len(values) // BLOCK)
    room = LAYOUT[0][0]
    padded = np.zeros((blocks, BLOCK + room), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(values)] = np.minimum(values, ESCAPE)
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    bits = bit_lengths(padded)
    # widest[c]: the most bits of c ids from each place on, from windows of powers of two.
    choice = np.full((blocks, BLOCK), len(LAYOUT) - 1, np.uint8)
    span, widest = 1, bits
    for selector, (count, width) in sorted(enumerate(LAYOUT), key=lambda x: x[1][0]):
        while span * 2 <= count:
            widest = np.maximum(widest[:, :-span], widest[:, span:])
            span *= 2
        most = np.maximum(widest[:, :BLOCK], widest[:, count - span : count - span + BLOCK])
        choice[most <= width] = selector
    counts = np.array([c for c, _ in LAYOUT])
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = len(values) - (blocks - 1) * BLOCK
    at, active = np.zeros(blocks, np.int64), np.arange(blocks)
    picked: list[tuple[np.ndarray, np.ndarray]] = []
    while len(active):
        place = at[active]
        picked.append((active, place))
        at[active] = place + counts[choice[active, place]]
        active = active[at[active] < lengths[active]]
    block = np.concatenate([b for b, _ in picked])
    place = np.concatenate([p for _, p in picked])
    order = np.lexsort((place, block))
    block, place = block[order], place[order]
    chosen = choice[block, place]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, (count, width) in enumerate(LAYOUT):
        if width and len(mine := np.flatnonzero(chosen == selector)):
            for j in range(count):
                words[mine] |= padded[block[mine], place[mine] + j] << np.uint64(j * width)
    firsts = np.searchsorted(block, np.arange(blocks)).astype(np.uint64)
    return words, firsts, escaped


def decompress(words: np.ndarray, firsts: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The n values."""
    counts = np.array([c for c, _ in LAYOUT])
    chosen = (words >> np.uint64(60)).astype(np.int64)
    sizes = counts[chosen]
    ends = np.cumsum(sizes)
    block = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts.astype(np.int64), len(words))))
    before = (ends - sizes)[firsts.astype(np.int64)] if len(firsts) else np.zeros(0, np.int64)
    at = block * BLOCK + (ends - sizes) - before[block]
    # Behind a block's end, and after the last value, there is room for what a last word has too many.
    stop = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for selector, (count, width) in enumerate(LAYOUT):
        if width and len(mine := np.flatnonzero(chosen == selector)):
            mask = np.uint64((1 << width) - 1)
            for j in range(count):
                inside = mine[at[mine] + j < stop[mine]]
                out[at[inside] + j] = (words[inside] >> np.uint64(j * width)) & mask
    out[out == ESCAPE] = escaped
    return out


def record(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, firsts, escaped = compress(ids)
    arrays = [(doc_ids, "<i8"), (nulls, "u1"), (counts, "<u8"), (firsts, "<u8"), (words, "<u8"), (escaped, "<u8")]
    body = b"".join(a.astype(kind).tobytes() for a, kind in arrays)
    return HEADER.pack(MAGIC, len(body), len(doc_ids), len(ids), len(words), len(escaped), zlib.crc32(body)) + body


def records(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, whether they are null, counts of ids, and ids, of each record."""
    while header := stream.read(HEADER.size):
        magic, size, documents, n, words, escapes, crc = HEADER.unpack(header)
        body = stream.read(size)
        if magic != MAGIC or len(body) != size or zlib.crc32(body) != crc:
            raise ValueError("damaged record")
        at, found = 0, []
        for count, kind in ((documents, "<i8"), (documents, "u1"), (documents, "<u8"), (-(-n // BLOCK), "<u8"), (words, "<u8"), (escapes, "<u8")):
            found.append(np.frombuffer(body, kind, count, at))
            at += found[-1].nbytes
        doc_ids, nulls, counts, firsts, packed, escaped = found
        yield doc_ids, nulls.astype(bool), counts.astype(np.int64), decompress(packed, firsts, escaped, n)


def uri_of(path: str) -> str:
    return path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1)


def write(docs: DataFrame, vocabulary: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None) -> DataFrame:
    """Write the ids of all documents in the order of their ids; the files: `part`, `path`, `documents`, `ids`, `ids_before`."""
    folder = uri_of(folder or f"{shared_folder(docs.sparkSession).rstrip('/')}/ids-{uuid.uuid4().hex}")
    key, text = F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text")
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    ordered = docs.select(key, text).repartitionByRange(*order[:2]).sortWithinPartitions(*order[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        encoder = encoder_for(vocabulary, end_id)
        system, root = fs.FileSystem.from_uri(folder)
        path = f"part-{context.partitionId():06d}-{uuid.uuid4().hex}.ids"
        stream, documents, total = None, 0, 0
        for batch in batches:
            keys = batch.column("doc_id")
            for first, stop, ids, bounds in encoded(batch.column("text"), encoder):
                if stream is None:
                    system.create_dir(root, recursive=True)
                    stream = system.open_output_stream(f"{root}/{path}")
                own = keys[first:stop]
                stream.write(record(own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False), np.diff(bounds), ids))
                documents, total = documents + stop - first, total + len(ids)
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([context.partitionId()], pa.int64()), "path": [f"{folder}/{path}"], "documents": pa.array([documents], pa.int64()), "ids": pa.array([total], pa.int64())})

    # Settled at once: these are the files that count. One row per file.
    files = settle(ordered.mapInArrow(run, "part long, path string, documents long, ids long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("ids_before", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(files: DataFrame) -> DataFrame:
    """Documents of the files: `doc_id`, `start` in all ids, `n_tokens`, `token_ids` (unsigned 32-bit, little endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("ids_before").to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_stream(name) as stream:
                    for doc_ids, nulls, counts, ids in records(stream):
                        bounds = np.concatenate([[0], np.cumsum(counts)])
                        small = ids.astype("<u4")
                        cut = [small[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids, pa.int64(), mask=nulls), pa.array(start + bounds[:-1], pa.int64()), pa.array(counts, pa.int64()), pa.array(cut, pa.binary())],
                            ["doc_id", "start", "n_tokens", "token_ids"],
                        )
                        start += len(ids)

    # A file is little for a shuffle but much for a task: the number keeps tasks from being merged.
    spread = files.select("part", "path", "ids_before").repartitionByRange(max(1, files.count()), "part")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, token_ids binary")
