"""Exact centroid clustering of vectors through dictionaries of their subvectors.

Vectors become whole numbers, floor(scale * component), and stay so: no distance, sum or centroid is ever
rounded. Each task cuts its vectors into chunks and encodes a chunk without loss: its dimensions are dealt
into blocks, a block's distinct subvectors are its dictionary, and a vector is one code per block. Blocks
begin one dimension wide; neighbours merge for as long as few distinct pairs of their codes occur, so
a chunk of copies ends in a few wide blocks and one of unrelated vectors in narrow ones. The chunks are
written once to the shared folder.

In a round, the squared distances between a dictionary's entries and that block of each centroid are
computed once, and a vector's distance is the sum of those its codes point at. Sums of a cluster's vectors go
through the codes too: how often each entry occurs in the cluster, times the entry. A task gives one
sum per cluster and dimension, Spark adds them up, and the driver sees clusters x dimensions numbers a
round, whatever the number of vectors. No vector is shuffled. The first centroids are the vectors with the smallest hashes, a
top-k of `clusters` rows.

Kept are vectors of exactly `dimensions` components, none of them null, NaN or infinite; others, null vectors
among them, give no row. With fewer kept vectors than clusters there are as many clusters as vectors.
A null id hashes like an empty one. Rows of equal id are separate vectors; if their ids tie for a
first centroid, the smaller vector (component by component) comes first. Equally near centroids: the smaller
number. A cluster without vectors keeps its centroid. Components of a size that would take a
squared distance beyond 64 bits (131,072 and more, with 64 dimensions and a scale of 1024) are an error, as no
distance could be returned; a sum of distances beyond 64 bits is null. Other columns don't matter, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import settle

#: Vectors that share dictionaries.
CHUNK = 16384
#: Blocks merge if a merged dictionary has at most one entry for so many vectors.
REPEATS = 8
LONG = 2**63


@dataclass
class Chunk:
    """Vectors as codes: `codes[b]` of each vector points into `entries[b]`, the rows of block b."""

    codes: list[np.ndarray]
    entries: list[np.ndarray]

    def size(self) -> int:
        return len(self.codes[0])

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distance of each vector to each centroid, as sums of entries' distances."""
        out = np.zeros((self.size(), len(centroids)), np.int64)
        first = 0
        for codes, entries in zip(self.codes, self.entries, strict=True):
            stop = first + entries.shape[1]
            apart = entries[:, None, :] - centroids[None, :, first:stop]
            out += (apart * apart).sum(axis=2)[codes]
            first = stop
        return out

    def sums(self, cluster: np.ndarray, clusters: int) -> np.ndarray:
        """Sum of each cluster's vectors, from how often it has each entry."""
        parts = []
        for codes, entries in zip(self.codes, self.entries, strict=True):
            n = len(entries)
            times = np.bincount(cluster * n + codes, minlength=clusters * n).reshape(clusters, n)
            parts.append(times @ entries)
        return np.concatenate(parts, axis=1)


def encode(vectors: np.ndarray) -> Chunk:
    """The whole-number vectors (one or more) as a chunk; `decode` gives them back."""
    blocks = []
    for column in vectors.T:
        entries, codes = np.unique(column, return_inverse=True)
        blocks.append((codes.astype(np.int64), entries[:, None]))
    merged = True
    while merged and len(blocks) > 1:
        merged, out, i = False, [], 0
        while i < len(blocks):
            pair = blocks[i : i + 2]
            found = joined(*pair, len(vectors)) if len(pair) == 2 else None
            merged |= found is not None
            out += pair[:1] if found is None else [found]
            i += 1 if found is None else 2
        blocks = out
    return Chunk([c for c, _ in blocks], [e for _, e in blocks])


def joined(left: tuple, right: tuple, vectors: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Two neighbouring blocks as one, if that has few entries."""
    (left_codes, left_entries), (right_codes, right_entries) = left, right
    limit = max(1, vectors // REPEATS)
    if max(len(left_entries), len(right_entries)) > limit:
        return None
    pairs, codes = np.unique(left_codes * len(right_entries) + right_codes, return_inverse=True)
    if len(pairs) > limit:
        return None
    a, b = np.divmod(pairs, len(right_entries))
    return codes.astype(np.int64), np.concatenate([left_entries[a], right_entries[b]], axis=1)


def decode(chunk: Chunk) -> np.ndarray:
    return np.concatenate([e[c] for c, e in zip(chunk.codes, chunk.entries, strict=True)], axis=1)


def whole(components: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * component) as 64-bit numbers."""
    return np.floor(components.astype(np.float64) * scale).astype(np.int64)


def limit_for(dimensions: int) -> int:
    """Components below this in size keep squared distances below 2 ** 63."""
    return isqrt((LONG - 1) // dimensions) // 2


CHUNK_SCHEMA = "ids array<{kind}>, codes binary, entries binary, widths array<int>, sizes array<int>"


def to_row(ids: pa.Array, chunk: Chunk) -> pa.RecordBatch:
    codes = b"".join(c.astype("<u2").tobytes() for c in chunk.codes)
    entries = b"".join(e.astype("<i8").tobytes() for e in chunk.entries)
    return pa.RecordBatch.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([codes], pa.binary()), pa.array([entries], pa.binary()),
            pa.array([[e.shape[1] for e in chunk.entries]], pa.list_(pa.int32())),
            pa.array([[len(e) for e in chunk.entries]], pa.list_(pa.int32())),
        ],
        ["ids", "codes", "entries", "widths", "sizes"],
    )


def from_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Chunk]]:
    for batch in batches:
        for i in range(len(batch)):
            ids = batch.column("ids")[i].values
            widths, sizes = batch.column("widths")[i].as_py(), batch.column("sizes")[i].as_py()
            codes = np.frombuffer(batch.column("codes")[i].as_buffer(), "<u2").reshape(len(widths), len(ids))
            flat, at, entries = np.frombuffer(batch.column("entries")[i].as_buffer(), "<i8"), 0, []
            for width, size in zip(widths, sizes, strict=True):
                entries.append(flat[at : at + width * size].reshape(size, width))
                at += width * size
            yield ids, Chunk([c.astype(np.int64) for c in codes], entries)


def usable(vector: Column, dimensions: int) -> Column:
    def finite(x: Column) -> Column:
        x = x.cast("double")
        return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))

    return F.coalesce(F.size(vector) == dimensions, F.lit(False)) & F.forall(vector, finite)


def encoded(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """The chunks of the kept vectors (`id`, `vector`), settled."""
    kind, limit = dict(vectors.dtypes)["id"], limit_for(dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            batch = pa.Table.from_batches(held).combine_chunks()
            flat = batch.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            if len(flat) and not np.abs(flat * scale).max() < limit:
                raise ValueError(f"a component of {limit / scale:g} or more has squared distances beyond 64 bits")
            return to_row(batch.column("id").combine_chunks(), encode(whole(flat, scale).reshape(-1, dimensions)))

        for batch in batches:
            for start in range(0, len(batch), CHUNK):
                part = batch.slice(start, CHUNK)
                if rows and rows + len(part) > CHUNK:
                    yield flush()
                    held, rows = [], 0
                held.append(part)
                rows += len(part)
        if rows:
            yield flush()

    return settle(vectors.mapInArrow(run, CHUNK_SCHEMA.format(kind=kind)))


def first_centroids(vectors: DataFrame, clusters: int, scale: int, seed: int) -> np.ndarray:
    """The kept vectors with the smallest hashes of seed and id, in the order of the hashes."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.orderBy(hashed, "vector").limit(clusters).collect()  # `clusters` rows at most
    return whole(np.array([r["vector"] for r in rows], np.float64), scale)


def totals(chunks: DataFrame, centroids: np.ndarray) -> tuple[list[list[int]], list[int], list[int]]:
    """Of each centroid's vectors: the componentwise sum, the number, and the sum of their distances."""
    clusters, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A chunk's sums fit 64 bits; those of a task need not.
        sums = np.zeros((clusters, dimensions + 2), object)
        for _, chunk in from_rows(batches):
            distances = chunk.distances(centroids)
            cluster = distances.argmin(axis=1)
            sums[:, :dimensions] += chunk.sums(cluster, clusters).astype(object)
            sums[:, dimensions] += np.bincount(cluster, minlength=clusters).astype(object)
            near = distances.min(axis=1)
            for c in range(clusters):
                # In halves of 32 bits, as a chunk's distances may add up to more than 64.
                own = near[cluster == c]
                sums[c, dimensions + 1] += (int((own >> 32).sum()) << 32) + int((own & 0xFFFFFFFF).sum())
        c, d = (x.ravel() for x in np.indices(sums.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array([str(x) for x in sums.ravel()])], ["cluster", "part", "total"]
        )

    parts = chunks.mapInArrow(run, "cluster int, part int, total string")
    added = parts.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = np.zeros((clusters, dimensions + 2), object)
    for r in added.collect():  # clusters x (dimensions + 2) rows
        out[r["cluster"], r["part"]] = int(r["total"])
    return out[:, :dimensions].tolist(), out[:, dimensions].tolist(), out[:, dimensions + 1].tolist()


def cluster(
    vectors: DataFrame,
    clusters: int = 8,
    rounds: int = 10,
    dimensions: int = 64,
    scale: int = 1024,
    seed: int = 3,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """`id_column`, `cluster`, `distance` (squared), `cluster_inertia`, `inertia` and `centroid_sha256` of every kept vector."""
    chosen = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
    kind = dict(chosen.dtypes)["id"]
    kept = chosen.where(usable(F.col("vector"), dimensions))
    chunks = encoded(kept, dimensions, scale)
    centroids = first_centroids(kept, clusters, scale, seed)
    if not len(centroids):
        centroids = np.zeros((1, dimensions), np.int64)  # there is nothing to assign
    for _ in range(rounds):
        sums, counts, _ = totals(chunks, centroids)
        moved = [[s // n for s in own] if n else old for own, n, old in zip(sums, counts, centroids.tolist(), strict=True)]
        if moved == centroids.tolist():
            break  # all further rounds are the same
        centroids = np.array(moved, np.int64)
    _, _, inertia = totals(chunks, centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk in from_rows(batches):
            distances = chunk.distances(centroids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(distances.argmin(axis=1), pa.int32()), pa.array(distances.min(axis=1), pa.int64())], ["id", "cluster", "distance"]
            )

    def long(x: int) -> Column:
        return F.lit(x if x < LONG else None).cast("long")

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = F.array([F.struct(long(i).alias("inertia"), F.lit(h).alias("sha256")) for i, h in zip(inertia, digests, strict=True)])
    return (
        chunks.mapInArrow(assigned, f"id {kind}, cluster int, distance long")
        .withColumn("of_cluster", F.get(own, F.col("cluster")))
        .select(
            F.col("id").alias(id_column), "cluster", "distance", F.col("of_cluster.inertia").alias("cluster_inertia"),
            long(sum(inertia)).alias("inertia"), F.col("of_cluster.sha256").alias("centroid_sha256"),
        )
    )
