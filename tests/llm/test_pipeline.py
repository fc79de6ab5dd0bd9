"""The pipeline against plain versions of its stages, and its stages on odd documents."""

from __future__ import annotations

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from logloom.llm.oracles import ORACLES
from logloom.session import settle
from tests.llm.test_decontaminate import plain as plain_leaks
from tests.llm.test_ids import plain as plain_ids
from tests.llm.test_near_dups import all_pairs

DATA = "/root/testdata/sf0.001"


def good(rows):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, s) for i, (_, t, s) in enumerate(rows)])
    kept = {i for (i,) in duck.execute(f"SELECT doc_id FROM ({ORACLES['op5_domain_quality']}) WHERE kept").fetchall()}
    return [r for i, r in enumerate(rows) if i in kept]


def own_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    for doc, text, _ in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                holders[key(line)].add(doc)
    out = []
    for doc, text, source in rows:
        lines = [x for x in (text or "").split("\n") if doc is None or len(h := holders.get(key(x), ())) < 2 or min(h) == doc]
        out.append((doc, "\n".join(lines), source))
    return out


def plain_pipeline(rows, items):
    rows = own_lines(good(rows))
    first = {}
    for row, (doc, least, _) in zip(rows, all_pairs([r[:2] for r in rows]), strict=True):
        first.setdefault(least, row if doc == least else None)
        if doc == least and first[least] is None:
            first[least] = row
    rows = list(first.values())
    bad = {d for d, _ in plain_leaks([r[:2] for r in rows], items)}
    return [r for r in rows if r[0] not in bad]


def test_whole_run(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = plain_pipeline(rows, items)
    ids = {doc: i for (doc, _, _), i in zip(want, plain_ids([t for _, t, _ in want]), strict=True)}
    pieces = corpus_pipeline.run(spark, DATA).collect()
    covered = defaultdict(int)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(bytes(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")))
        covered[p.doc_id] += p.length
    assert covered == {d: len(i) for d, i in ids.items()}
    fills = defaultdict(int)
    for p in pieces:
        fills[p.sequence_id] += p.length
    assert sorted(fills) == list(range(len(fills))) and all(f == 4096 or f & (f - 1) == 0 for f in fills.values())


@pytest.fixture
def odd(spark):
    long_text = " ".join(f"w{i}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (None, "", "en", "s", 0), (2, long_text, "en", "s", 1), (2, long_text, "en", "s", 1), (3, long_text + " end", "en", None, 2),
        (4, "some clean words " + " ".join(f"x{i}" for i in range(30)), None, "t", None), (None, "other clean words " + " ".join(f"y{i}" for i in range(30)), "de", "t", 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", "1 AS row", "'x' AS id", "2 AS h1", "'k' AS kept", "3 AS node", "4 AS spans", "5 AS n_words", "6 AS domain")


def test_stages_on_odd_documents(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = settle(stage(spark, docs, DATA))
        assert kept.columns == docs.columns, name
        assert [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema], name
        docs = kept
    assert sorted(((r.doc_id or 0, r.n_chars) for r in docs.collect()), key=str) == sorted([(0, len(r.text)) if r.doc_id is None else (r.doc_id, len(r.text)) for r in docs.collect()], key=str)
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 2, 4]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() > 0


def test_stages_on_no_documents(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), DATA).count() == 0
