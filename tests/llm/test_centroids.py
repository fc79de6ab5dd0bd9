"""Exact clustering through dictionaries of subvectors, against plain rounds in whole numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(rows, clusters=8, rounds=10, dimensions=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    by_hash = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in by_hash[:clusters]]

    def nearest(v):
        apart = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centers]
        return apart.index(min(apart)), min(apart)

    for _ in range(rounds):
        own = [nearest(v)[0] for _, v in kept]
        for c in range(len(centers)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if members:
                centers[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    final = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, c, d in final if c == k) for k in range(len(centers))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, inertia[c], sum(inertia), digest[c]) for i, c, d in final), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 9), st.integers(1, 6), st.integers(0, 99))
def test_chunks_are_lossless_and_exact(n, dimensions, values, seed):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-values, values, (n, dimensions))
    vectors[: n // 2] = vectors[0]
    chunk, centers = centroids.encode(vectors), rng.integers(-values, values, (3, dimensions))
    assert np.array_equal(centroids.decode(chunk), vectors)
    distances = ((vectors[:, None] - centers) ** 2).sum(axis=2)
    assert np.array_equal(chunk.distances(centers), distances)
    own = distances.argmin(axis=1)
    assert np.array_equal(chunk.sums(own, 3), np.array([vectors[own == c].sum(axis=0) for c in range(3)]))
    ids, again = next(centroids.from_rows([centroids.to_row(centroids.pa.array(range(n)), chunk)]))
    assert ids.to_pylist() == list(range(n)) and np.array_equal(centroids.decode(again), vectors)


def test_copies_share_wide_blocks():
    chunk = centroids.encode(np.tile(np.arange(64), (100, 1)))
    assert [e.shape for e in chunk.entries] == [(1, 64)]
    rng = np.random.default_rng(0)
    assert len(centroids.encode(rng.integers(0, 10**6, (100, 64))).entries) == 64


@pytest.mark.parametrize("chunk", [4, 16384])
def test_odd_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(centroids, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 64).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (0, rows[3][1]), (None, rows[1][1]), (None, [0.0] * 64)]  # copies, equal and null ids
    bad = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [0.0] * 63), (205, [math.nan] + [0.0] * 63), (206, [math.inf] + [0.0] * 63), (207, [-math.inf] * 64)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], SCHEMA).repartition(3)
    assert found(centroids.cluster(df)) == plain(rows)


def test_few_vectors_and_ties(spark):
    one = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.25] * 64)]
    df = spark.createDataFrame([(i, v, None) for i, v in one], SCHEMA)
    assert found(centroids.cluster(df)) == plain(one)
    empty = centroids.cluster(df.where("vec_id > 9"))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_beyond_64_bits(spark):
    most = float(centroids.limit_for(64) - 1) / 1024
    rows = [(1, [most] * 64), (2, [-most] * 64), (3, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(centroids.cluster(df, clusters=2)) == plain(rows, clusters=2)
    with pytest.raises(Exception, match="beyond 64 bits"):
        centroids.cluster(spark.createDataFrame([(1, [2 * most] * 64)], "vec_id long, embedding array<double>"))


def test_other_shapes(spark):
    rows = [(i, [float(i % 5), i / 7]) for i in range(40)]
    df = spark.createDataFrame([(str(i), v) for i, v in rows], "name string, v array<double>")
    got = centroids.cluster(df, clusters=3, rounds=4, dimensions=2, id_column="name", vector_column="v")
    assert found(got) == sorted(((str(i), *rest) for i, *rest in plain(rows, 3, 4, 2)), key=str)
