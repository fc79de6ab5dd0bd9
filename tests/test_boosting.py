"""Boosting by block sums against Spark's own regression, round by round."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.sql import functions as F

from logloom.plans import boosting, models
from logloom.schema import STUDENT
from logloom.session import settle


@pytest.fixture(scope="module")
def rows(spark):
    """Features of unlike units, a constant one, sparse and dense vectors; 300 rows."""
    rng = np.random.default_rng(6)
    data = []
    for i in range(300):
        a, b, c = rng.normal(size=3)
        truth = float(a + 0.5 * b + rng.normal() > 0.2)
        values = [a * 1e5 + 3e5, b, 0.0 if i % 3 else c * 1e-3, 7.0]
        vector = Vectors.dense(values) if i % 2 else SparseVector(4, [(k, v) for k, v in enumerate(values) if v])
        data.append((i, truth, vector))
    return settle(spark.createDataFrame(data, [STUDENT, "label", "features"]).repartition(3))


def by_spark(rows, rounds):
    """The same rounds with Spark's optimiser, run to the end."""
    regression = LogisticRegression(weightCol="weight", regParam=1.0, maxIter=1000, tol=1e-14)
    rows, out = rows.withColumn("weight", F.lit(1.0)), []
    for _ in range(rounds):
        model = regression.fit(rows)
        tried = model.transform(rows).withColumn("missed", (F.col("prediction") != F.col("label")).cast("double"))
        total, wrong = tried.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("missed"))).first()
        strength = math.log((total - wrong) / wrong)
        out.append((strength, model.intercept, model.coefficients.toArray().tolist()))
        raised = F.col("weight") * F.exp(strength * F.col("missed")) / F.lit(total)
        rows = settle(tried.withColumn("weight", raised).select(STUDENT, "label", "features", "weight"))
    return out


@pytest.mark.parametrize("merged", [1, 16])
def test_rounds_equal_sparks(rows, monkeypatch, merged):
    monkeypatch.setattr(boosting, "MERGED", merged)
    found, expected = boosting.boost(rows, 4, 4), by_spark(rows, 4)
    assert len(found) == 4
    for one, other in zip(found, expected, strict=True):
        assert one[0] == pytest.approx(other[0], abs=1e-6) and one[1] == pytest.approx(other[1], abs=1e-6)
        scaled = np.array([1e5, 1, 1e-3, 1])
        assert np.abs((np.array(one[2]) - other[2]) * scaled).max() < 1e-6
        assert one[2][3] == 0


def test_blocks_are_of_any_size(rows, monkeypatch):
    whole = boosting.boost(rows, 4, 2)
    monkeypatch.setattr(boosting, "BLOCK", 50)
    for one, other in zip(boosting.boost(rows, 4, 2), whole, strict=True):
        assert [one[0], one[1], *one[2]] == pytest.approx([other[0], other[1], *other[2]])


def test_beyond_the_limit_sparks_optimiser_takes_over(rows):
    own = models.BoostedRegression(2).fit(rows, None)
    other = models.BoostedRegression(2, most_features=3).fit(rows, None)
    for one, two in zip(own.members, other.members, strict=True):
        assert one[0] == pytest.approx(two[0], abs=1e-3) and one[1] == pytest.approx(two[1], abs=1e-3)


def test_perfect_and_hopeless_rows(spark):
    easy = spark.createDataFrame([(i, float(i >= 5), Vectors.dense([float(i)])) for i in range(10)], [STUDENT, "label", "features"])
    assert [m[0] for m in boosting.boost(settle(easy), 1, 5)] == [1.0]
    one_kind = spark.createDataFrame([(i, float(i % 2), Vectors.dense([1.0])) for i in range(10)], [STUDENT, "label", "features"])
    assert len(boosting.boost(settle(one_kind), 1, 5)) == 1
