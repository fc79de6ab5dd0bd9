from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from logloom.operators import sparse
from logloom.plans import folds, metrics, models, routine
from logloom.schema import LABEL, STUDENT
from logloom.session import settle

P, TRUTH = metrics.PROBABILITY, metrics.TRUTH


@pytest.fixture(scope="module")
def guesses(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(np.round(rng.random(), 1)), int(rng.random() < 0.4), i % 3) for i in range(120)]
    return spark.createDataFrame(data, f"{STUDENT} long, {P} double, {TRUTH} int, fold int").cache()


def pair_auc(pairs) -> float:
    good, bad = [p for p, t in pairs if t], [p for p, t in pairs if not t]
    return float(np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]))


def test_auc(guesses):
    data = guesses.collect()
    expected = pair_auc([(r[P], r[TRUTH]) for r in data])
    assert metrics.auc(guesses) == pytest.approx(expected)
    by_fold = dict(rows(metrics.rank_auc(guesses, ["fold"])))
    for fold in range(3):
        assert by_fold[fold] == pytest.approx(pair_auc([(r[P], r[TRUTH]) for r in data if r["fold"] == fold]))


def test_kappa(guesses):
    data = guesses.collect()
    guess, real = np.array([r[P] > 0.5 for r in data]), np.array([r[TRUTH] == 1 for r in data])
    agree = np.mean(guess == real)
    chance = guess.mean() * real.mean() + (1 - guess.mean()) * (1 - real.mean())
    row = metrics.with_kappa(metrics.confusion(guesses)).first()
    assert row["kappa"] == pytest.approx((agree - chance) / (1 - chance))
    assert metrics.accuracy(guesses).first()["accuracy"] == pytest.approx(agree)


def test_worse_than_chance_scores_nothing(spark):
    df = spark.range(1).select(*[c.alias(n) for n, c in metrics.adjusted(F.lit(0.4), F.lit(-0.2)).items()])
    assert rows(df) == [(0.0, 0.0, 0.0)]


def test_describe(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "x double")
    row = metrics.describe(df, ["x"]).first()
    assert (row["count"], row["mean"], row["min"], row["q50"], row["max"]) == (5, 4.0, 1.0, 3.0, 10.0)


@pytest.mark.parametrize("max_rows", [7, 10**6])
def test_quartiles_are_exact(spark, max_rows):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=501).round(2), rng.integers(0, 4, 501).astype(float)
    data = [(float(a), None if i % 7 == 0 else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame([(*r, None) for r in data], "x double, y double, z double")
    found = {r["column"]: r for r in metrics.describe(df, ["x", "y", "z"], max_rows).collect()}
    for name, values in (("x", x), ("y", [b for _, b in data if b is not None])):
        assert [found[name][q] for q in ("q25", "q50", "q75")] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75]).tolist())
    assert (found["z"]["count"], found["z"]["q50"]) == (0, None)


@pytest.mark.parametrize("seed", [None, 8])
def test_folds_are_stratified(spark, seed):
    people = spark.range(100).select(F.col("id").alias(STUDENT), (F.col("id") % 4 == 0).alias("label"))
    found = folds.stratified_folds(people, 3, seed)
    counts = found.groupBy("label", "fold").count().collect()
    for label, sizes in ((True, {8, 9}), (False, {25})):
        assert {r["count"] for r in counts if r["label"] == label} == sizes
    assert rows(folds.stratified_folds(people, 3, seed)) == rows(found)


def test_hash_split(spark):
    people = spark.range(3000).select(F.col("id").alias(STUDENT))
    chosen = people.where(folds.hash_split(F.col(STUDENT), 0.2, seed=1))
    assert 500 < chosen.count() < 700
    other = people.where(folds.hash_split(F.col(STUDENT), 0.2, seed=2))
    assert rows(chosen) != rows(other)


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(2)
    data = []
    for i in range(150):
        a, b = rng.normal(size=2)
        data.append((i, float(a), float(b), bool(a + 0.3 * rng.normal() > 0)))
    return spark.createDataFrame(data, f"{STUDENT} long, x_a double, x_b double, label boolean").cache()


NAMES = ["x_a", "x_b"]


def probabilities_are_fine(found, n):
    data = found.collect()
    assert len(data) == n
    assert all(0 <= r[P] <= 1 and r[P] + r["probability_false"] == pytest.approx(1) for r in data)


def test_forest(training):
    hidden = training.drop("label")
    _, found = models.fit_predict(training, hidden, NAMES, models.random_forest(10))
    probabilities_are_fine(found, 150)
    _, again = models.fit_predict(training, hidden, NAMES, models.random_forest(10))
    assert rows(found) == rows(again)


def test_grid_and_best(training):
    table = models.forest_grid(training, NAMES, trees=[1, 15], fractions=[1.0])
    assert table.count() == 2
    best = models.best_setting(table, models.FOREST_PARAMETERS)
    assert best[0] in (1, 15) and table.agg(F.max("adj_score")).first()[0] > 0.8
    model = models.best_forest(training, NAMES, table)
    probabilities_are_fine(models.probabilities(model, training), 150)


def test_best_setting_with_hopeless_scores(spark):
    table = spark.createDataFrame([(2, 0.5, 0.0), (1, 0.5, 0.0)], "trees int, feature_fraction double, adj_score double")
    assert models.best_setting(table, models.FOREST_PARAMETERS) == (1, 0.5)


def test_fold_table(training):
    folded = folds.stratified_folds(training, 2, seed=8)
    found = models.fold_metrics(models.cross_predictions(folded, NAMES, models.random_forest(10)))
    assert found.columns == ["fold", "loss", "auc", "accuracy", "kappa"]
    assert all(r["auc"] > 0.8 for r in found.collect())


def test_boosting(training):
    model = models.BoostedRegression(4, settle_every=2).fit(training, NAMES)
    assert 1 <= len(model.members) <= 4
    found = model.predict(training, "label")
    probabilities_are_fine(found, 150)
    right = found.agg(F.avg(((F.col(P) > 0.5) == F.col("label")).cast("int"))).first()[0]
    assert right > 0.8
    table = models.boosted_grid(training, NAMES, rounds=[1, 2], folds=2)
    assert table.count() == 2
    best = models.best_boosted(training, NAMES, table)
    assert len(best.members) <= models.best_setting(table, ["rounds"])[0]


def test_boosting_by_its_first_rounds_and_saved(spark, training, tmp_path):
    long = models.BoostedRegression(4).fit(training, NAMES)
    short = models.BoostedRegression(2).fit(training, NAMES)
    for one, other in zip(long.members, short.members):
        assert [one[0], one[1], *one[2]] == pytest.approx([other[0], other[1], *other[2]])
    staged = {r[STUDENT]: r["staged"] for r in long.staged(training, [2, 4, 9]).collect()}
    for place, model in ((0, short), (1, long), (2, long)):
        found = {r[STUDENT]: r[P] for r in model.predict(training).collect()}
        assert {s: v[place] for s, v in staged.items()} == pytest.approx(found)
    # The vote written out.
    data = training.select(STUDENT, *NAMES).collect()
    for r in data[:20]:
        sides = [s if sum(w * r[n] for w, n in zip(c, NAMES)) + b > 0 else -s for s, b, c in long.members]
        share = sum(sides) / sum(s for s, _, _ in long.members)
        assert staged[r[STUDENT]][1] == pytest.approx(1 / (1 + np.exp(-share)))
    path = str(tmp_path / "boosted")
    first = models.load_or_train_boosted(path, lambda: short)
    again = models.load_or_train_boosted(path, lambda: long)
    assert (first.members, again.members, again.names) == (short.members, short.members, list(NAMES))


def test_common_features(spark):
    schema = f"{STUDENT} long, feature string, value double"
    train = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], schema)
    hidden = spark.createDataFrame([(2, "b", 3.0), (2, "c", 4.0)], schema)
    labels = spark.createDataFrame([(1, True)], f"{STUDENT} long, label boolean")
    wide, other, index = models.training_tables(train, hidden, labels)
    assert rows(index) == [("b", 0)]
    assert rows(wide, STUDENT, "label", "features") == [(1, True, SparseVector(1, {0: 2.0}))]
    assert rows(other) == [(2, SparseVector(1, {0: 3.0}))]


def test_roster_gets_zero_and_students_are_unique(spark):
    schema = f"{STUDENT} long, {P} double"
    one, two = spark.createDataFrame([(1, 0.5)], schema), spark.createDataFrame([(2, 0.25)], schema)
    roster = spark.createDataFrame([(3, 0), (1, 1), (2, 2)], f"{STUDENT} long, ord long")
    found = routine.on_roster(roster, routine.stack_predictions([one, two])).orderBy("ord")
    assert [r[P] for r in found.collect()] == [0.0, 0.5, 0.25]
    with pytest.raises(PySparkException, match="more than one batch"):
        routine.on_roster(roster, routine.stack_predictions([one, one])).collect()


def test_model_is_trained_once(training, tmp_path):
    calls = []

    def train():
        calls.append(1)
        return models.pipeline(NAMES, models.random_forest(2)).fit(models.as_training(training))

    path = str(tmp_path / "model")
    models.load_or_train(path, train)
    again = models.load_or_train(path, train)
    assert len(calls) == 1
    probabilities_are_fine(models.probabilities(again, training), 150)


def test_a_model_follows_its_training_rows(spark, training, tmp_path):
    calls = []

    def train():
        calls.append(1)
        return models.pipeline(NAMES, models.random_forest(2)).fit(models.as_training(training))

    path = str(tmp_path / "model")
    content = models.content_of("forest", training)
    # The order and the partitions of rows don't matter.
    assert models.content_of("forest", training.repartition(7).orderBy("x_a").select(*reversed(training.columns))) == content
    for _ in range(2):
        models.load_or_train(path, train, content)
    assert len(calls) == 1
    changed = training.withColumn("x_a", F.when(F.col(STUDENT) == 7, 0.0).otherwise(F.col("x_a")))
    others = [models.content_of("forest", changed), models.content_of("forest of 3", training), models.content_of("forest", training.unionByName(training.limit(1)))]
    assert len({content, *others}) == 4
    models.load_or_train(path, train, others[0])
    models.load_or_train(path, train, others[0])
    assert len(calls) == 2
    # A save that ended before the note is no model of that content.
    spark.range(1).select(F.lit("").alias("value")).write.mode("overwrite").text(f"{path}.content")
    models.load_or_train(path, train, others[0])
    assert len(calls) == 3


def test_votes_add_up_to_the_forest(training):
    folded = folds.stratified_folds(training, 3)
    test = folded.withColumn("truth", F.col("label").cast("int"))
    model = models.pipeline(NAMES, models.random_forest(12)).fit(models.as_training(training))
    votes = models.votes(model, test, "truth", "fold")
    assert votes.count() == 12 * 150
    whole = {r[STUDENT]: r[P] for r in models.probabilities(model, training).collect()}
    found = models.prefix_predictions(votes, [1, 5, 12], "truth", "fold").collect()
    assert {r[STUDENT]: r[P] for r in found if r["trees"] == 12} == pytest.approx(whole)
    # The first five trees, one by one.
    rows_of = model.stages[0].transform(training)
    total = {}
    for tree in model.stages[-1].trees[:5]:
        out = tree.transform(rows_of).select(STUDENT, vector_to_array("rawPrediction").alias("raw"))
        for r in out.collect():
            total[r[STUDENT]] = total.get(r[STUDENT], 0.0) + r["raw"][1] / sum(r["raw"]) / 5
    assert {r[STUDENT]: r[P] for r in found if r["trees"] == 5} == pytest.approx(total)


def test_features_beyond_the_columns_of_a_table(spark):
    """12,000 features of 60 students: forest, grid, regression and boosting train on them."""
    n, sets = 12_000, {"train": range(60), "hidden": range(100, 130)}
    limit = spark.conf.get("spark.sql.pivotMaxValues")
    tables = {}
    for task, students in sets.items():
        people = spark.createDataFrame([(s,) for s in students], f"{STUDENT} long")
        own = people.select(STUDENT, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).where((F.col("k") * 7 + F.col(STUDENT) * 13) % 20 == 0)
        few = people.select(STUDENT, F.explode(F.array(F.lit(1), F.lit(n - 1))).alias("k"))
        tables[task] = own.unionByName(few).distinct().select(
            STUDENT, F.format_string("m_%05d", "k").alias("feature"), (F.when(F.col("k") == 1, F.col(STUDENT) % 2 * 5 + 1).otherwise(1)).cast("double").alias("value"),
        )
    labels = spark.createDataFrame([(s, s % 2 == 1) for s in (*sets["train"], *sets["hidden"])], f"{STUDENT} long, label boolean")
    train, hidden, index = models.training_tables(tables["train"], tables["hidden"], labels)
    assert index.count() == n > int(limit)
    assert train.count() == 60 and hidden.count() == 30
    long = sparse.entries(train).join(index.select(F.col("index").cast("int").alias("index"), "feature"), "index")
    assert rows(long, STUDENT, "feature", "value") == rows(tables["train"])
    _, found = models.fit_predict(train, hidden, None, models.random_forest(4, 0.05, max_depth=4))
    probabilities_are_fine(found, 30)
    boosted = models.BoostedRegression(2, max_iter=5).fit(train, None)
    probabilities_are_fine(boosted.predict(hidden), 30)
    right = boosted.predict(train, "label").agg(F.avg(((F.col(P) > 0.5) == F.col("label")).cast("int"))).first()[0]
    assert right == 1


def test_sparse_rows_of_odd_features(spark):
    schema = f"{STUDENT} long, feature string, value double"
    long = spark.createDataFrame([(1, "b", 2.0), (1, "a", 0.0), (2, "c", None), (3, "a", 5.0), (3, "a", 4.0), (4, "z", 1.0), (None, "b", 1.0)], schema)
    index = sparse.feature_index(long.where("feature != 'z'"))
    assert rows(index) == [("a", 0), ("b", 1), ("c", 2)]
    found = dict(rows(sparse.sparse_rows(long, index)))
    # Zeros and nulls are no entries; the smaller of two values counts; students without features of the index are out.
    assert found == {1: SparseVector(3, {1: 2.0}), 2: SparseVector(3, {}), 3: SparseVector(3, {0: 4.0}), None: SparseVector(3, {1: 1.0})}
    assert sparse.sparse_rows(long.where("false"), index).collect() == []
    batches = long.withColumn("batch", F.when(F.col(STUDENT) == 1, "10").otherwise("20"))
    per_batch = sparse.feature_index(batches)
    assert {(r["batch"], r["features"].size) for r in sparse.sparse_rows(batches, per_batch).collect()} == {("10", 2), ("20", 4)}


def test_products_of_dense_and_sparse_vectors():
    rng = np.random.default_rng(4)
    values = rng.normal(size=(5, 4)) * (rng.random((5, 4)) < 0.6)
    values[3] = 0
    kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    data = []
    for i, row in enumerate(values):
        at = np.flatnonzero(row)
        data.append({"type": 1, "size": None, "indices": None, "values": row.tolist()} if i % 2 else {"type": 0, "size": 4, "indices": at.tolist(), "values": row[at].tolist()})
    matrix = rng.normal(size=(4, 3))
    assert np.allclose(models.products(pa.array(data, kind), matrix), values @ matrix)
    assert models.products(pa.array([], kind), matrix).shape == (0, 3)


def test_training_rows_are_spread(spark, training):
    """A table that Spark reads in one task is trained on in several, and always alike."""
    many = settle(training.crossJoin(spark.range(60).select(F.col("id").alias("copy"))).withColumn(STUDENT, F.col(STUDENT) * 60 + F.col("copy")).coalesce(1))
    assert many.rdd.getNumPartitions() == 1 and many.count() == 9000
    parts = models.spread(many)
    assert parts.rdd.getNumPartitions() == 3 and rows(parts) == rows(many)
    assert models.spread(training) is training
    seen = []

    class Watched(models.RandomForestClassifier):
        def _fit(self, dataset):
            seen.append(dataset.rdd.getNumPartitions())
            return super()._fit(dataset)

    watched = Watched(featuresCol="features", labelCol=LABEL, numTrees=2, seed=0)
    first, again = (models.fitted(many, NAMES, watched) for _ in range(2))
    assert seen == [3, 3]
    assert rows(models.probabilities(first, training)) == rows(models.probabilities(again, training))
