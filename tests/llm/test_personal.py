"""Patterns against their plain expressions, the tagger on held-out samples, and the query."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from logloom.llm import personal, tagger
from logloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else None,
                "card": 13 <= len(digits) <= 19 and sum(d if d < 10 else d - 9 for d in doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def model():
    return personal.trained()


def test_patterns_on_random_texts():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789012345 4.@-+()aB.é\n") for _ in range(rng.randrange(60)))
        assert personal.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text", ["", "a@b.c@d.e", "@b.c@d.e", "1.2.3.4.5.6.7.8.9", "300.1.2.3.4", "4111 1111 1111 1111", "+1 (826) 555-4081 190.12.3.4", "00001.2.3.4", "x" * 50 + "@" * 9])
def test_patterns_on_odd_texts(text):
    assert personal.base_spans(text) == plain_spans(text)


def test_long_runs_are_read_in_one_pass():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+" * 100_000, "a@" * 50_000, "1 " * 100_000):
        personal.base_spans(text)


def test_gradients():
    rng = np.random.default_rng(0)
    scores, tags = rng.normal(size=(3, 6, 3)), rng.integers(0, 3, (3, 6))
    steps = rng.normal(size=(3, 3))
    loss, d_scores, d_steps = tagger.crf_back(scores, tags, steps)
    for at in [(0, 0, 0), (1, 3, 2), (2, 5, 1)]:
        moved = scores.copy()
        moved[at] += 1e-4
        assert (tagger.crf_back(moved, tags, steps)[0] - loss) / 1e-4 == pytest.approx(d_scores[at], abs=1e-3)
    for at in [(0, 0), (1, 2)]:
        moved = steps.copy()
        moved[at] += 1e-4
        assert (tagger.crf_back(scores, tags, moved)[0] - loss) / 1e-4 == pytest.approx(d_steps[at], abs=1e-3)


def test_decoding_is_the_best_path():
    rng = np.random.default_rng(4)
    t = tagger.Tagger(("x",), {"next": rng.normal(size=(3, 3)).astype(np.float32)})
    scores, lengths = rng.normal(size=(8, 5, 3)).astype(np.float32), np.array([5, 1, 2, 3, 4, 5, 5, 2])
    tags = t.decode(scores, lengths)
    steps = t.weights["next"] + tagger.forbidden(("x",))
    for row, n in enumerate(lengths):
        value = lambda path, row=row, n=n: sum(scores[row, i, p] for i, p in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:], strict=False))
        best = max(np.ndindex(*[3] * n), key=value)
        assert tuple(tags[row, :n]) == best


def test_held_out_samples(model):
    held = personal.invented_samples(400, seed=99)
    found = personal.tagged([t for t, _ in held], model)
    right = sum(len(set(f) & set(w)) for f, (_, w) in zip(found, held, strict=True))
    assert right / sum(map(len, found)) > 0.9
    assert right / sum(len(w) for _, w in held) > 0.93
    added = [(t, w, s) for (t, w), row in zip(held, personal.all_spans([t for t, _ in held], model), strict=True) for s in row if not s[3]]
    assert sum(s[:3] in w for _, w, s in added) > 0.97 * len(added)


def test_a_text_gives_the_same_alone_and_among_others(model):
    texts = [t for t, _ in personal.invented_samples(60, seed=5)] + ["", "no numbers here", "x" * 3000]
    together = personal.all_spans(texts, model)
    assert [personal.all_spans([t], model)[0] for t in texts] == together


def test_long_texts_are_read_to_the_end(model):
    entity = 'and token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" there'
    text = "some words " * 50_000 + entity + " 12 more" * 3000 + " " + entity
    spans = personal.all_spans([text], model)[0]
    want = [m.span() for m in re.finditer("[0-9a-f]{40}", text)]
    assert [s[1:3] for s in spans if s[0] == "secret"] == want


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, "mail me: é a.b@c.example.com, or 4111-1111-1111-1111."), (2, "mail me: é a.b@c.example.com, or 4111-1111-1111-1111."), (3, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS found", "'y' AS spans", "'z' AS row")
    result = personal.find(docs, redact=True)
    assert result.columns == ["doc_id", "text", "found", "spans", "row", "redacted"]
    got = sorted(((r.doc_id or 0, r.redacted, len(r.spans)) for r in result.collect()), key=str)
    clean = "mail me: é <email>, or <card>."
    assert got == sorted([(1, None, 0), (0, "", 0), (2, clean, 2), (2, clean, 2), (3, "nothing", 0)], key=str)
    assert personal.find(docs.limit(0)).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    order = ["email", "ip", "card", "phone", "secret"]
    for r in QUERIES["op7_bilstm_crf_pii"](spark, DATA).collect():
        base = plain_spans(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in order[:4]]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert spans == sorted(spans, key=lambda s: (order.index(s[0]), int(s[1]), int(s[2])))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))
        values = [m.span(1) for m in re.finditer(r'(?:token = "|password=)([0-9a-f]+)', docs[r.doc_id])]
        assert {(int(a), int(b)) for k, a, b in spans if k == "secret"} >= set(values)


def test_whole_texts(spark):
    """Reading everything finds what reading around anchors does, and windows over the seams of pieces agree."""
    samples = personal.invented_samples(40, seed=77)
    model = personal.trained()
    texts = [t for t, _ in samples] + ["", "no anchor here", "x" * 3000 + " mail me: a.b@example.org " + "y" * 3000]
    near, whole = (personal.all_spans(texts, model, whole=w) for w in (False, True))
    for text, some, more in zip(texts, near, whole, strict=True):
        assert {s for s in some if s[3]} <= set(more)
        assert personal.stretches(text, whole=True) == [(a, min(a + personal.PIECE, len(text))) for a in range(0, len(text), personal.PIECE)]
    some, more = ({(i, *s) for i, row in enumerate(rows) for s in row} for rows in (near, whole))
    assert len(some & more) >= 0.97 * len(some)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in personal.find(df, whole=True).collect()}
    assert [got[i] for i in range(len(texts))] == whole


def test_the_tagger_is_kept(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(personal, "shared_folder", lambda _: str(tmp_path))
    calls = []
    monkeypatch.setattr(personal, "trained", lambda samples, seed: calls.append(samples) or personal.train(personal.invented_samples(samples, seed), personal.KINDS))
    one, again = (personal.kept(spark, samples=40) for _ in range(2))
    assert calls == [40] and len(list(tmp_path.iterdir())) == 1
    texts = [t for t, _ in personal.invented_samples(5, seed=9)]
    assert personal.all_spans(texts, one) == personal.all_spans(texts, again)
    personal.kept(spark, samples=41)
    assert calls == [40, 41]
