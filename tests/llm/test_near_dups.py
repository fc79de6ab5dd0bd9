"""Near duplicates against all pairs, and the parts on their own."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import near_dups
from logloom.llm.components import components
from logloom.llm.queries import QUERIES
from logloom.llm.words import hashes, words_of

DATA = "/root/testdata/sf0.001"


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in text.split(" ") if w]


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def weights(text):
    w = words(text)
    counts = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
    return {x: 1 + np.log(n) for x, n in counts.items()}


def probability_jaccard(a, b):
    """By its definition, a sum over all pairs of shingles."""
    union = list({*a, *b})
    x, y = (np.array([side.get(u, 0.0) for u in union]) for side in (a, b))
    both = (x > 0) & (y > 0)
    return sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero(both))


def linked(one, other):
    """Whether two texts are alike as sets of shingles, or by the weights of their counts."""
    a, b = weights(one), weights(other)
    both = len(a.keys() & b.keys())
    if not both:
        return False
    if 5 * both >= 4 * (len(a) + len(b) - both):
        return True
    return max(*a.values(), *b.values()) > 1 and probability_jaccard(a, b) >= 0.8


def all_pairs(rows):
    """Class ids by comparing everything with everything."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingle_set(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            equal = (rows[i][1] or "") == (rows[j][1] or "")
            if equal or not sets[i].isdisjoint(sets[j]) and linked(rows[i][1], rows[j][1]):
                parent[root(i)] = root(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in ids.items()}
    return [(doc, least[root(i)], len(ids[root(i)])) for i, (doc, _) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_words_and_hashes(monkeypatch):
    monkeypatch.setattr("logloom.llm.words.SEGMENT_BYTES", 7)
    texts = ["", "a  bc\n", "Ab", "AB ab", " ", "é É x" + "y" * 40 + " z", "\x0b\x0c", "end"]
    w = words_of(pa.array(texts))
    got = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert [x.split() for x in texts] == [got[a:b] for a, b in zip(w.firsts[:-1], w.firsts[1:], strict=True)]
    h = dict(zip(got, hashes(w.data, w.starts, w.ends).tolist(), strict=True))
    assert h["Ab"] == h["AB"] == h["ab"] and len(set(h.values())) == len({words(x)[0] for x in got})


def test_shingles_are_whole():
    texts = ["a b c d e f a b c d e", "a b", "", "x", "p q r s t"]
    text, shingle, count = near_dups.shingles(pa.array(texts))
    assert np.bincount(text, minlength=5).tolist() == [6, 1, 0, 1, 1]
    assert sorted(count[text == 0].tolist()) == [1, 1, 1, 1, 1, 2]
    assert len(set(shingle.tolist())) == 9


def test_registers_estimate_the_probability_jaccard():
    rng = random.Random(3)
    for common, own in ((40, 5), (80, 80), (9, 1)):
        base = [f"c{rng.random()}" for _ in range(common)]
        sides = [[*base, *[f"{s}{i}" for i in range(own)]] for s in "ab"]
        weights = {x: rng.choice([1, 2, 5]) for x in base}
        ids = {x: np.uint64(rng.getrandbits(64)) for side in sides for x in side}
        text = np.repeat([0, 1], common + own)
        shingle = np.array([ids[x] for side in sides for x in side])
        count = np.array([weights.get(x, 1) for side in sides for x in side])
        w = [{x: 1 + np.log(weights.get(x, 1)) for x in side} for side in sides]
        exact = sum(
            1 / sum(max(w[0].get(y, 0) / w[0][x], w[1].get(y, 0) / w[1][x]) for y in {*sides[0], *sides[1]}) for x in base
        )
        shares = []
        for seed in range(40):
            a, b = near_dups.signatures(text, shingle + np.uint64(seed * 977), count, 2)
            shares.append((a == b).mean())
        assert np.mean(shares) == pytest.approx(exact, abs=0.03)


def test_shared_counts(monkeypatch):
    monkeypatch.setattr("logloom.llm.near_dups.COLUMNS", 5)
    rng = random.Random(8)
    sets = [np.array(sorted(rng.sample(range(60), rng.randrange(30))), np.uint32) for _ in range(20)]
    assert near_dups.shared_counts(sets).tolist() == [[len({*a.tolist()} & {*b.tolist()}) for b in sets] for a in sets]
    assert near_dups.shared_counts([np.zeros(0, np.uint32)] * 2).tolist() == [[0, 0], [0, 0]]


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 200)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def top(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    nodes = {x for link in links for x in link}
    assert {x: roots.get(x, x) for x in nodes} == {x: top(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c"), (4, "A  b\tc"), (4, "a b c"), (4, "other words"), (5, "other words"), (5, "other words"), (6, "x")]
    assert found(near_dups.classes(frame(spark, rows))) == sorted(all_pairs(rows), key=str)
    assert near_dups.classes(frame(spark, [])).count() == 0
    clash = frame(spark, rows).selectExpr("doc_id", "text", "1 AS id", "2 AS h1", "3 AS row", "'n' AS node")
    kept = near_dups.keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect())[0][0] == 1
    assert kept.count() == len({c for _, c, _ in all_pairs(rows)}) + 1  # the blank text has no words: a class of its own
    assert near_dups.keep_one(clash.limit(0)).count() == 0


def test_measures():
    rng = random.Random(12)
    kinds = Counter()
    for _ in range(300):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 60))]
        other = base[: rng.randrange(len(base) + 1)] + [f"v{rng.randrange(60)}" for _ in range(rng.choice([0, 0, 2, 9]))]
        pair = [" ".join(base * rng.choice([1, 1, 7])), " ".join(other * rng.choice([1, 3]) + base[:9])]
        if rng.random() < 0.2:  # most of the weight is in what both repeat
            pair = [" ".join(base * 40 + [f"{side}{i}" for i in range(len(base) // 5 + 6)]) for side in "xy"]
        part = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(pair)], ["node", "text"])
        (batch,) = near_dups.shingle_sets(iter([part]))
        one, two = near_dups.weighted_sets(batch.column("shingles"), batch.column("counts"))
        assert batch.column("n").to_pylist() == [len(shingle_set(t)) for t in pair]
        exact = probability_jaccard(*map(weights, pair))
        assert near_dups.probability_jaccard(one, two) == pytest.approx(exact)
        assert near_dups.alike(one, two) == linked(*pair)
        sets = [shingle_set(t) for t in pair]
        kinds[len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]), exact >= 0.8] += 1
    assert len(kinds) == 4  # each measure has pairs that the other has not


@pytest.mark.parametrize("block", [8, 1024])
def test_chains_and_groups(spark, monkeypatch, block):
    """Groups around a base, a chain of neighbours, and texts that only share half."""
    monkeypatch.setattr("logloom.llm.near_dups.BLOCK", block)
    monkeypatch.setattr("logloom.llm.near_dups.BLOCK_SHINGLES", 200 * block)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    base = rng.choices(vocabulary, k=300)
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(300)] = rng.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    text = rng.choices(vocabulary, k=200)
    for i in range(200, 260):  # each like the next, the ends unlike
        text = text[6:] + rng.choices(vocabulary, k=6)
        rows.append((i, " ".join(text)))
    half = rng.choices(vocabulary, k=100)
    rows += [(i, " ".join(half + rng.choices(vocabulary, k=100))) for i in range(300, 340)]
    rows += [(400, " ".join(half)), (401, " ".join([*half, "x"]))]
    # Alike by the weights of what they repeat, or only as sets.
    loud = rng.choices(vocabulary, k=100)
    for i in range(500, 530):
        rows.append((i, " ".join(loud * rng.randrange(20, 40) + rng.choices(vocabulary, k=rng.choice([40, 60, 80])))))
    for i in range(600, 630):
        rows.append((i, " ".join(base[:280] + rng.choices(vocabulary, k=10) + base[:60] * rng.choice([0, 30]))))
    rng.shuffle(rows)
    assert found(near_dups.classes(frame(spark, rows))) == sorted(all_pairs(rows), key=str)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert found(QUERIES["op6_prob_minhash"](spark, DATA)) == sorted(all_pairs(rows), key=str)


def test_unequal_repeats_keep_the_set_jaccard():
    rng = random.Random(9)
    shares, sets, missed = [], [], 0
    for _ in range(20):
        base = [f"w{rng.random()}" for _ in range(1000)]
        other = [*base[:900], *[f"v{rng.random()}" for _ in range(100)]]
        pair = [" ".join(base), " ".join(other + base[:300] * 50)]
        a, b = (shingle_set(t) for t in pair)
        sets.append(len(a & b) / len(a | b))
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(pair)], ["h1", "text"])
        x, y = (np.frombuffer(r, "<u4") for out in near_dups.sketched(iter([batch])) for r in out.column("registers").to_pylist())
        shares.append((x == y).mean())
        width = near_dups.ROWS
        missed += not any((x[width * k : width * (k + 1)] == y[width * k : width * (k + 1)]).all() for k in range(near_dups.BANDS))
    assert min(sets) >= 0.8
    assert np.mean(shares) == pytest.approx(np.mean(sets), abs=0.03)
    assert not missed
