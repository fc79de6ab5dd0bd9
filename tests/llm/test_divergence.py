"""Divergence of sources: bitmaps against plain counts, and odd rows against SQL."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import divergence
from logloom.llm.oracles import ORACLES

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
TEXTS = [
    None, "", "  ", "1234 !? @[`{\x7f", "Apple apple APPLE pear", "apple-pear_pear", "Äpfel ÄPFEL äpfel", "a1b2c3 a b c", "ﬁsh İx y z​",
    "pear pear pear pear", "z" * 5000, "apple " * 3000, "\x00apple\x00pear\x00",
]


def plain(docs, least=3, most=200):
    """Rows (lang, source, part, item, value, rank) from (text, lang, source)."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(TERM.findall((t or "").translate(lower)), lang or "", s or "") for t, lang, s in docs]
    out = []
    for lang in {d[1] for d in docs}:
        own = [(terms, s) for terms, x, s in docs if x == lang]
        seen, total = Counter(), Counter()
        for terms, _ in own:
            seen.update(set(terms))
            total.update(terms)
        kept = sorted(t for t in total if seen[t] >= least)
        counts = {s: Counter() for _, s in own}
        for terms, s in own:
            counts[s].update(t for t in terms if seen[t] >= least)

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        of_lang, p = shares(total), {s: shares(c) for s, c in counts.items()}

        def f(a, b):
            return (a - b) * (a - b) // b

        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], of_lang[t])) for t in kept if counts[s][t] and p[s][t] > of_lang[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1) if part == "pair" or k <= most]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_terms():
    texts = [t or "" for t in TEXTS]
    text, code, terms = divergence.terms_of(pa.array(texts))
    got = [[] for _ in texts]
    for t, c in zip(text, code, strict=True):
        got[t].append(terms[c])
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    assert got == [TERM.findall(t.translate(lower)) for t in texts]
    assert [len(x) for x in divergence.terms_of(pa.array(["x"] + texts).slice(1, 3))] == [0, 0, 0]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(0, 9), st.integers(0, 99))
def test_cells(terms, most, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, most + 1, terms), rng.integers(0, most + 1, terms)
    sets = []
    for counts in (a, b):
        rows = np.zeros((most, -(-terms // 64)), np.uint64)
        for place, n in enumerate(counts):
            if n:
                rows[n - 1, place // 64] |= np.uint64(1) << np.uint64(place % 64)
        sets.append(rows)
    expected = np.zeros((most + 1, most + 1), int)
    np.add.at(expected, (a, b), 1)
    assert np.array_equal(divergence.cells(*sets, terms, divergence.intersections(*sets)), expected)


def rows_of_words(seed=1, n=300):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    skewed = 1 / np.arange(1, 401)
    out = []
    for _ in range(n):
        source = f"s{int(rng.integers(0, 7))}" if rng.random() < 0.6 else "hot"
        out.append((" ".join(rng.choice(words, int(rng.integers(0, 60)), p=skewed / skewed.sum())), rng.choice(["en", "de"]), source))
    return out


@pytest.mark.parametrize(("chunk", "block", "held"), [(1024, 64, 400_000), (50, 2, 100)])
def test_against_plain_counts(spark, monkeypatch, chunk, block, held):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    docs = [(str(t), str(lang), s) for t, lang, s in rows_of_words()]
    docs += [(t, lang, s) for t in TEXTS for lang in (None, "en", "xx") for s in (None, "s1")]
    docs += [("only words that occur in one document", "rare", s) for s in ("a", "b", "c")] + [(None, "none", "a"), (None, "none", "b"), ("lonely", "one", "a")]
    df = spark.createDataFrame([(i % 5, t, lang, s, "x") for i, (t, lang, s) in enumerate(docs)], "doc_id long, text string, lang string, source string, n string")
    # A few terms only, so that the limit of the report is reached.
    assert found(divergence.audit(df.repartition(5), most_terms=20)) == plain(docs, most=20)


def test_no_rows(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(df).collect() == []


def test_large_counts(spark):
    counts = spark.createDataFrame([(0, 0, 1), (5, 10, 3), (10**12, 3 * 10**12, 10**7), (10**15, 10**15, 1)], "n long, total long, terms long")
    got = [r[0] for r in counts.select(divergence.share(counts["n"], "total", "terms")).collect()]
    assert got == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in [(0, 0, 1), (5, 10, 3), (10**12, 3 * 10**12, 10**7), (10**15, 10**15, 1)]]


def test_odd_rows_against_sql(spark, tmp_path):
    docs = [(i, t, lang, s) for i, (t, lang, s) in enumerate((t, lang, s) for t in TEXTS for lang in ("en", None) for s in ("a", "b", None))]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = duck.execute(ORACLES["op13_divergence_audit"])
    columns = [c[0] for c in result.description]
    assert found(divergence.audit(df).select(columns)) == sorted(result.fetchall())
