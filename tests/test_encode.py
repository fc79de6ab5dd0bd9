from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from logloom.operators import encode
from logloom.operators.behaviour import padded
from logloom.operators.clean import clean_log
from logloom.operators.series import dense_rows, second_series
from logloom.schema import ITEM, STUDENT, VERB


def test_code_book_is_sorted_and_shared(spark):
    df = spark.createDataFrame([("b",), ("a",), ("0",), (None,), ("b",)], "w string")
    book = encode.code_book(df, "w")
    assert rows(book) == [("0", 0), ("a", 1), ("b", 2)]
    assert rows(encode.with_codes(df, "w", book)) == [(0,), (1,), (2,), (2,), (None,)]


def test_a_book_per_batch(spark):
    df = spark.createDataFrame([("1", "b"), ("1", "a"), ("2", "c"), ("2", "b")], "batch string, w string")
    book = encode.code_book(df, "w", by=["batch"])
    assert rows(book) == [("1", "a", 0), ("1", "b", 1), ("2", "b", 0), ("2", "c", 1)]
    assert rows(encode.with_codes(df, "w", book)) == [("1", 0), ("1", 1), ("2", 0), ("2", 1)]


def test_mask_is_code_zero(make_log):
    spans = second_series(make_log([(1, 0, "A", "x"), (2, 0, "B", "y"), (2, 3, "B", "y")]), limit=4)
    coded, books = encode.encoded_series(spans)
    after = dense_rows(coded).where((F.col(STUDENT) == 1) & (F.col("occur_second") > 0))
    assert rows(after.select(ITEM, VERB).distinct()) == [(0, 0)]
    assert rows(books[ITEM]) == [("0", 0), ("A", 1), ("B", 2)]
    assert rows(encode.encoding_dims(spans)) == [("item_id", 3), ("item_type", 2), ("observable", 3), ("verb_weight", 6)]


def test_unseen_values_are_all_zeros(spark):
    train = spark.createDataFrame([("1", "x"), ("2", "x"), ("1", "y")], "a string, b string")
    other = spark.createDataFrame([("2", "y"), ("7", "x"), ("1", "z")], "a string, b string")
    model = encode.one_hot_model(train, ["a", "b"])
    found = encode.one_hot(model, other).select("a", vector_to_array("features").alias("v")).collect()
    assert {r["a"]: r["v"] for r in found} == {"2": [0, 1, 0, 1], "7": [0, 0, 1, 0], "1": [1, 0, 0, 0]}


@pytest.mark.parametrize("max_rows", [3, 1000])
def test_one_hot_of_a_sliced_vocabulary(spark, max_rows):
    """Many values, nulls, repeated rows, and a column that is called like one of the operator's."""
    data = [(f"v{(i * 7) % 23:02d}" if i % 5 else None, "" if i % 3 == 0 else f"{i % 4}", i) for i in range(60)] + [("v01", "1", 1)] * 3
    df = spark.createDataFrame(data, "a string, b string, value int")
    model = encode.one_hot_model(df.where("value < 40"), ["a", "b"], max_rows)
    known = [sorted({r[k] for r in data if r[2] < 40 and r[k] is not None}) for k in (0, 1)]
    assert rows(model.book, "code", "position", "value") == sorted(((c, p, v) for c, (p, v) in enumerate((p, v) for p in (0, 1) for v in known[p])), key=lambda r: tuple((x is None, str(x)) for x in r))
    encoded = encode.one_hot(model, df)
    assert encoded.columns == ["a", "b", "value", "features"] and encoded.count() == len(data)
    names = [(p, v) for p in (0, 1) for v in known[p]]
    for r in encoded.collect():
        assert r["features"].toArray().tolist() == [float(r[p] == v) for p, v in names]
    assert encode.one_hot(model, df.limit(0)).collect() == []
    nothing = encode.one_hot_model(df.limit(0), ["a", "b"])
    assert {r["features"].size for r in encode.one_hot(nothing, df).collect()} == {0}


def test_equal_width_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 0.9, 1, 3, 5.99, 6)], "w double")
    assert [r[0] for r in encode.equal_width_bins(df, "w").collect()] == [1, 1, 2, 4, 6, 6]
    same = spark.createDataFrame([(2.0,), (2.0,)], "w double")
    assert rows(encode.equal_width_bins(same, "w")) == [(1,), (1,)]


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Minimum of the weighted logistic loss plus half the squared length."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (weight * (p - y)) + beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(beta))
        beta -= np.linalg.solve(hessian, gradient)
    return beta


def test_verb_weights_solve_the_regression(spark, make_log):
    rng = np.random.default_rng(1)
    verbs = ["p", "q", "r", "s"]
    events = [(int(s), n, "A", verbs[min(3, int(rng.integers(0, 3) + s % 2))]) for n, s in enumerate(rng.integers(1, 20, 300))]
    labels = spark.createDataFrame([(s, s % 2 == 1) for s in range(1, 20)], "student_id long, label boolean")
    found = encode.verb_weights(clean_log(make_log(events)), labels)
    y = np.array([e[0] % 2 for e in events], dtype=float)
    x = np.array([[e[3] == v for v in verbs] + [True] for e in events], dtype=float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    expected = newton(x, y, weight)
    values = {r[VERB]: r["verb_weight"] for r in found.collect()}
    assert [values[f"{v}_"] for v in verbs] == pytest.approx(list(expected[:4]), abs=1e-8)


def test_unknown_verbs_get_the_neutral_weight(spark, make_log):
    log = make_log([(1, 0, "A", "x"), (1, 2, "A", "y"), (2, 0, "A", "y")])
    weights = spark.createDataFrame([("A", "x_", 6)], f"{ITEM} string, {VERB} string, verb_weight int")
    found = encode.weight_rows(log, weights)
    assert rows(found, STUDENT, "position", "verb_weight", "verb_duration") == [(1, 0, 6, 2.0), (1, 1, 4, 0.0), (2, 0, 4, 0.0)]
    assert rows(padded(found, "verb_weight", 0), STUDENT, "position", "verb_weight") == [
        (1, 0, 6), (1, 1, 4), (2, 0, 4), (2, 1, 0),
    ]


def test_embedding_width(spark):
    df = spark.createDataFrame([(20,), (100,), (3,)], "d int")
    assert [r[0] for r in df.select(encode.embedding_width(F.col("d"))).collect()] == [2, 5, 0]


def test_folds_by_subtraction(spark, make_log):
    """Weights from total less fold equal those fitted to the other folds alone, also for pairs of one fold only."""
    rng = np.random.default_rng(3)
    data = [(s, n, "AB"[int(rng.integers(2))], "wxyz"[int(rng.integers(4))]) for s in range(24) for n in range(int(rng.integers(1, 9)))]
    data += [(3, 50, "C", "rare"), (0, 51, None, "x"), (1, 52, "A", None)]
    log = clean_log(make_log(data))
    labels = spark.createDataFrame([(s, s % 5 < 2, s % 4) for s in range(23)], f"{STUDENT} long, label boolean, fold int")
    found = rows(encode.verb_weights_by_fold(log, labels))
    for fold in range(4):
        alone = rows(encode.verb_weights(log, labels.where(F.col("fold") != fold)))
        own = [r[1:] for r in found if r[0] == fold]
        assert [r[:2] for r in own] == [r[:2] for r in alone]
        assert [r[2] for r in own] == pytest.approx([r[2] for r in alone], abs=1e-8)
    assert not [r for r in found if r[0] == 3 and "rare" in r[2]]
