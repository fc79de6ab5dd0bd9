"""Fingerprints: estimates against exact similarities, neighbours across partitions, classes against all pairs."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import fingerprints
from logloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "one", "ONE", "one two three four", "one two three four five", "École übt  \n jeden Tag sehr gern", "a " * 3000, "x" * 40000, "one two"]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sets(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lowered(text or "")).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def exact(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def in_order(rows):
    """Texts by descending id, null ids last."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def check(got, rows):
    """Rows of distinct ids against a plain walk."""
    ordered = in_order(rows)
    following = ordered[1:] + ordered[:1]
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for (i, text), (j, after) in zip(ordered, following, strict=True):
        text, after, r = text or "", after or "", by_id[i]
        half = len(text) // 2
        made = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(made.encode()).hexdigest()
        assert r["jaccard_edited"] == pytest.approx(exact(text, made)) and r["jaccard_next"] == pytest.approx(exact(text, after))
        for near, true in ((r["near_edited"], r["jaccard_edited"]), (r["near_next"], r["jaccard_next"])):
            assert abs(near - true) < 0.25  # over five standard deviations of 125 draws
        assert r["near_next"] == np.mean([a == b for a, b in zip(numbers(r["fingerprint"]), numbers(by_id[j]["fingerprint"]), strict=True)])
        if text == made:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
    return by_id


def numbers(hexed):
    return np.frombuffer(bytes.fromhex(hexed) if isinstance(hexed, str) else bytes(hexed), "<u2").tolist()


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    by_id = check(QUERIES["op12_minhash_fingerprints"](spark, DATA).collect(), docs)
    same = {}
    for i, text in docs:
        same.setdefault(text or "", set()).add(by_id[i]["fingerprint"])
    assert all(len(prints) == 1 for prints in same.values())


@pytest.mark.parametrize("partitions", [1, 7])
def test_odd_texts(spark, partitions):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "the last one of all rows here")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(fingerprints.against_next(df).collect(), rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_row_no_row_and_equal_ids(spark):
    one = spark.createDataFrame([(1, "some words that are here")], "doc_id long, text string")
    (r,) = fingerprints.against_next(one).collect()
    assert r["near_next"] == 1 and r["edited_sha256"] == hashlib.sha256(b"some words tsome words t").hexdigest()
    assert fingerprints.against_next(one.where("doc_id > 1")).collect() == []
    many = spark.createDataFrame([(1, f"text number {i} of one id") for i in range(50)], "doc_id long, text string")
    assert fingerprints.against_next(many).count() == 50


def test_signatures_are_minima_of_permutations():
    rng = np.random.default_rng(3)
    text = np.sort(rng.integers(0, 5, 200))
    shingle = rng.integers(0, 2**63, 200).astype(np.uint64)
    found = fingerprints.signatures(text, shingle, 6)
    for t in range(6):
        own = [int(s) for s in shingle[text == t]]
        for k in (0, 7, 124):
            least = min(((s * int(fingerprints.MULTIPLIERS[k]) + int(fingerprints.SHIFTS[k])) % 2**64 for s in own), default=2**64 - 1)
            assert found[t, k] == (((least ^ (least >> 32)) % 2**16) if len(own) else 2**16 - 1)


def test_signatures_of_long_texts_in_steps(monkeypatch):
    texts = pa.array([" ".join(f"w{i % 700}" for i in range(3000)), "a b c", " ".join(f"v{i}" for i in range(900))])
    own = fingerprints.shingles_of(texts)
    whole = fingerprints.signatures(*own, 3)
    monkeypatch.setattr(fingerprints, "STEP", 64)
    assert np.array_equal(fingerprints.signatures(*own, 3), whole)


def test_classes_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [(1000 + i, t) for i, t in enumerate(ODD)]
    parent = {i: i for i, _ in docs}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shingled = [(i, t or "", sets(t)) for i, t in docs]
    for n, (i, text, own) in enumerate(shingled):
        for j, other, theirs in shingled[:n]:
            common = len(own & theirs)
            if text == other or 5 * common >= 4 * (len(own) + len(theirs) - common) > 0:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in fingerprints.classes(df).collect()} == {i: top(i) for i, _ in docs}


def test_fingerprints_of_a_table(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    found = {r["doc_id"]: bytes(r["fingerprint"]) for r in fingerprints.fingerprints(df).collect()}
    assert found[0] == found[1] == found[2] and found[3] == found[4] != found[5]
    assert all(len(f) == 2 * fingerprints.PERMUTATIONS for f in found.values())
