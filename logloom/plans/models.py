"""Spark ML classifiers over wide features, their cross-validation and choice."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.operators.sparse import SPARSE, VECTOR, feature_index, sparse_rows
from logloom.plans.boosting import MOST_FEATURES, boost
from logloom.plans.folds import stratified_folds
from logloom.plans.forest import GrownForest, grid_predictions, grow_forest, in_tasks
from logloom.plans.metrics import PROBABILITY, TRUTH, adjusted, confusion, rank_auc, with_kappa
from logloom.schema import LABEL, STUDENT
from logloom.session import delete, scratch_path, settle
from logloom.sources.files import path_exists

# --- Fixed values: the search spaces. -------------------------------------------------
TREES = [500, 1500, 3000]
FEATURE_FRACTIONS = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65]
BOOSTING_ROUNDS = [500, 1000, 1500, 2000, 2500]
CROSS_VALIDATION = 3
# --- End of fixed values. -------------------------------------------------------------

#: Trees grow until their leaves are pure, or to the deepest that Spark's trees go.
FULL_DEPTH = 30
#: Settings of a grid that are tried at the same time.
PARALLELISM = 4
#: Training rows of one partition.
TRAINING_ROWS = 4096


def random_forest(
    trees: int = 3000, feature_fraction: float = 0.3, seed: int = 0, max_depth: int = FULL_DEPTH
) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="features",
        labelCol=LABEL,
        numTrees=trees,
        featureSubsetStrategy=str(feature_fraction),
        maxDepth=max_depth,
        seed=seed,
    )


def common_features(train: DataFrame, hidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long features of both logs without those that only one of them has."""
    names = train.select("feature").distinct().join(
        hidden.select("feature").distinct(), "feature", "left_semi"
    )
    return tuple(df.join(names, "feature", "left_semi") for df in (train, hidden))


def labelled(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Feature rows of students with a label."""
    return features.join(labels.select(STUDENT, LABEL), STUDENT)


def training_tables(
    train: DataFrame, hidden: DataFrame, labels: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train rows with label and hidden rows, with `features` over the features both have, and their index.

    Features are sparse vectors, nulls and missing ones 0, so there may be any number of them.
    Training reads its rows many times: all three tables are written out.
    """
    train, hidden = common_features(train, hidden)
    index = feature_index(train)
    return sparse_rows(labelled(train, labels), index, [LABEL]), sparse_rows(hidden, index), index


#: Columns that hold the features, or none if the rows have vectors called `features`.
Names = Sequence[str] | None


def vectorised(rows: DataFrame, names: Names) -> DataFrame:
    """`rows` with the vector `features`."""
    return VectorAssembler(inputCols=list(names), outputCol=VECTOR).transform(rows) if names else rows


def pipeline(names: Names, classifier: Estimator) -> Pipeline:
    assembler = [VectorAssembler(inputCols=list(names), outputCol=VECTOR)] if names else []
    return Pipeline(stages=[*assembler, classifier])


def as_training(data: DataFrame) -> DataFrame:
    return data.withColumn(LABEL, F.col(LABEL).cast("double"))


def spread(rows: DataFrame, size: int = TRAINING_ROWS) -> DataFrame:
    """`rows` in partitions of about `size` students, by id; at most that many rows stay as they are.

    A training table is a small file of many rows, which Spark reads in one task. A forest passes over it for
    every level of its trees, so all levels would have one core. Rows have the same places in every run, as the
    forest's draws depend on them.
    """
    parts = math.ceil(rows.count() / size)
    return rows if parts <= 1 else rows.repartition(parts, STUDENT).sortWithinPartitions(STUDENT)


def fitted(data: DataFrame, names: Names, classifier: Estimator) -> PipelineModel | GrownForest:
    """The classifier trained on labelled rows; large forests grow in tasks."""
    rows = as_training(data)
    if size := in_tasks(classifier, vectorised(rows, names)):
        return grow_forest(vectorised(rows, names), names, classifier, *size)
    return pipeline(names, classifier).fit(spread(rows))


def probabilities(model: Model | GrownForest, rows: DataFrame, *keep: str) -> DataFrame:
    """Probability of False and True per student."""
    if isinstance(model, GrownForest):
        return model.predict(vectorised(rows, model.names), *keep)
    values = vector_to_array("probability")
    return model.transform(rows).select(
        STUDENT,
        *keep,
        values[0].alias("probability_false"),
        values[1].alias(PROBABILITY),
    )


def fit_predict(
    train: DataFrame, hidden: DataFrame, names: Names, classifier: Estimator
) -> tuple[PipelineModel | GrownForest, DataFrame]:
    """Train on labelled rows; probabilities of the hidden students."""
    model = fitted(train, names, classifier)
    return model, probabilities(model, hidden)


def cross_predictions(
    data: DataFrame, names: Names, classifier: Estimator
) -> DataFrame:
    """Each student's probability from the model fitted on the other folds."""
    rows = as_training(data)
    folds = [r[0] for r in data.select("fold").distinct().orderBy("fold").collect()]
    parts = []
    for fold in folds:
        model = fitted(rows.where(F.col("fold") != fold), names, classifier)
        test = rows.where(F.col("fold") == fold).withColumn(TRUTH, F.col(LABEL).cast("int"))
        parts.append(probabilities(model, test, TRUTH, "fold"))
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return joined


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """Loss, accuracy, AUC and kappa of each fold."""
    p = F.greatest(F.least(F.col(PROBABILITY), F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = -F.when(F.col(TRUTH) == 1, F.log(p)).otherwise(F.log(1 - p))
    losses = predictions.groupBy("fold").agg(F.avg(loss).alias("loss"))
    kappas = with_kappa(confusion(predictions, ["fold"]))
    return (
        losses.join(rank_auc(predictions, ["fold"]), "fold")
        .join(kappas.select("fold", "accuracy", "kappa"), "fold")
    )


def score(predictions: DataFrame) -> DataFrame:
    """One row: adjusted mean fold AUC, adjusted kappa over all students, and their sum."""
    mean_auc = rank_auc(predictions, ["fold"]).agg(F.avg("auc").alias("auc"))
    kappa = with_kappa(confusion(predictions)).select("kappa")
    row = kappa.withColumn("auc", mean_auc.scalar())
    return row.select(*[c.alias(n) for n, c in adjusted(F.col("auc"), F.col("kappa")).items()])


def scores_by(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """The row of `score` for each group, such as the settings of a grid, in one job."""
    mean_auc = rank_auc(predictions, [*by, "fold"]).groupBy(*by).agg(F.avg("auc").alias("auc"))
    kappa = with_kappa(confusion(predictions, by)).select(*by, "kappa")
    found = kappa.join(mean_auc, list(by), "left")
    return found.select(*by, *[c.alias(n) for n, c in adjusted(F.col("auc"), F.col("kappa")).items()])


def best_setting(scores: DataFrame, parameters: Sequence[str]) -> tuple:
    """Parameters of the best score; the first of equals."""
    order = [F.desc("adj_score"), *parameters]
    return tuple(scores.orderBy(*order).select(*parameters).first())


FOREST_PARAMETERS = ["trees", "feature_fraction"]


def leaf_table(spark: SparkSession, model: RandomForestClassificationModel) -> DataFrame:
    """`tree`, `leaf` (its number in the tree from the left) and `p`, the share of True in it, as the saved forest has them."""
    path = scratch_path(spark)
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").where("leftChild < 0")
    in_tree = Window.partitionBy("treeID").orderBy("id")
    stats = F.col("impurityStats")
    share = F.coalesce(F.get(stats, F.lit(1)) / F.aggregate(stats, F.lit(0.0), lambda a, b: a + b), F.lit(0.0))
    return nodes.select(F.col("treeID").alias("tree"), (F.row_number().over(in_tree) - 1).alias("leaf"), share.alias("p"))


def votes(model: PipelineModel, rows: DataFrame, *keep: str) -> DataFrame:
    """One row per student and tree: `p`, the tree's probability of True.

    The trees of a forest are independent draws, so its first n are a forest of n: one fit
    serves every number of trees.
    """
    forest = model.stages[-1]
    leaves = vector_to_array("leaves").cast("array<int>")
    reached = forest.copy({forest.leafCol: "leaves"}).transform(PipelineModel(model.stages[:-1]).transform(rows))
    placed = reached.select(STUDENT, *keep, F.posexplode(leaves).alias("tree", "leaf"))
    return placed.join(leaf_table(rows.sparkSession, forest), ["tree", "leaf"]).select(STUDENT, *keep, "tree", "p")


def prefix_predictions(votes: DataFrame, sizes: Sequence[int], *keep: str) -> DataFrame:
    """Each student's probability by the first n trees, a row for each n of `sizes`, called `trees`."""
    counted = votes.groupBy(STUDENT, *keep).agg(*[F.sum(F.when(F.col("tree") < n, F.col("p"))).alias(f"_{i}") for i, n in enumerate(sizes)])
    values = [F.struct(F.lit(n).alias("trees"), (F.col(f"_{i}") / n).alias(PROBABILITY)) for i, n in enumerate(sizes)]
    return counted.select(STUDENT, *keep, F.inline(F.array(*values)))


def forest_grid(
    data: DataFrame,
    names: Names,
    trees: Sequence[int] = tuple(TREES),
    fractions: Sequence[float] = tuple(FEATURE_FRACTIONS),
    folds: int = CROSS_VALIDATION,
    max_depth: int = FULL_DEPTH,
    parallelism: int = PARALLELISM,
) -> DataFrame:
    """Cross-validated scores of every number of trees and feature fraction, one row each.

    A fraction is fitted once a fold, with the largest number of trees; fewer are the first ones of it. Large
    forests grow in the tasks of one job.
    """
    rows = settle(as_training(stratified_folds(data, folds)))
    truth = F.col(LABEL).cast("int").alias(TRUTH)
    columns = [*FOREST_PARAMETERS, "adj_auc", "adj_kappa", "adj_score"]
    forests = [random_forest(max(trees), f, max_depth=max_depth) for f in fractions]
    if size := in_tasks(forests[0], vectorised(rows, names)):
        tested = vectorised(rows, names).select(STUDENT, LABEL, "fold", VECTOR, truth)
        found = grid_predictions(tested, forests, trees, folds, *size, [TRUTH, "fold"])
        scored = scores_by(found, ["setting", "trees"]).collect()  # one row per setting
        ordered = sorted(scored, key=lambda r: (r["setting"], trees.index(r["trees"])))
        table = [(r["trees"], fractions[r["setting"]], *(float(r[c] or 0.0) for c in columns[2:])) for r in ordered]
        return data.sparkSession.createDataFrame(table, columns)

    def tried(fraction: float) -> list[tuple]:
        parts = []
        for fold in range(folds):
            forest = random_forest(max(trees), fraction, max_depth=max_depth)
            # Not spread: the fits that run at the same time already share the cores.
            model = pipeline(names, forest).fit(rows.where(F.col("fold") != fold))
            test = rows.where(F.col("fold") == fold).select("*", truth)
            parts.append(prefix_predictions(votes(model, test, TRUTH, "fold"), trees, TRUTH, "fold"))
        found = settle(reduce(DataFrame.unionByName, parts))
        scores = [(n, score(found.where(F.col("trees") == n)).first()) for n in trees]
        return [(n, fraction, *(float(x or 0.0) for x in result)) for n, result in scores]

    with ThreadPoolExecutor(parallelism) as pool:
        tables = pool.map(inheritable_thread_target(data.sparkSession)(tried), fractions)
        table = list(itertools.chain.from_iterable(tables))
    return data.sparkSession.createDataFrame(table, columns)


def best_forest(
    data: DataFrame, names: Names, scores: DataFrame, max_depth: int = FULL_DEPTH
) -> PipelineModel | GrownForest:
    """Fit the best setting of the grid to all rows."""
    trees, fraction = best_setting(scores, FOREST_PARAMETERS)
    forest = random_forest(trees, fraction, max_depth=max_depth)
    return fitted(data, names, forest)


def products(vectors: pa.StructArray, coefficients: np.ndarray) -> np.ndarray:
    """Vectors (sparse or dense, as Spark hands them to Arrow) times the columns of a matrix."""
    values = vectors.field("values")
    rows = np.repeat(np.arange(len(vectors)), np.diff(values.offsets.to_numpy()))
    sparse = vectors.field("type").to_numpy(zero_copy_only=False) == SPARSE
    index = np.zeros(len(rows), np.int64)
    index[sparse[rows]] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
    firsts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(vectors)))])
    place = np.arange(len(rows)) - firsts[rows]
    index = np.where(sparse[rows], index, place)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), coefficients.shape[1]))
    filled = np.flatnonzero(np.diff(firsts))
    # A few columns at a time: entries x columns numbers are held.
    step = max(1, (1 << 22) // max(1, len(rows)))
    for first in range(0, coefficients.shape[1], step):
        terms = flat[:, None] * coefficients[index, first : first + step]
        if len(filled):
            out[filled, first : first + step] = np.add.reduceat(terms, firsts[:-1][filled])
    return out


class BoostedRegression:
    """Boosted logistic regression: each round weighs the rows missed so far higher.

    Its members are linear, so it is a strength, an intercept and coefficients per round: as
    many numbers as rounds x features, and all rounds vote in one matrix product.
    """

    def __init__(self, rounds: int, settle_every: int = 5, max_iter: int = 200, most_features: int = MOST_FEATURES):
        self.rounds = rounds
        self.settle_every = settle_every
        self.max_iter = max_iter
        self.most_features = most_features
        self.names: list[str] = []
        self.members: list[tuple[float, float, list[float]]] = []

    def fit(self, data: DataFrame, names: Names) -> BoostedRegression:
        """By Newton steps of block sums for up to `most_features` features, else by Spark's optimiser."""
        rows = vectorised(as_training(data), names).select(STUDENT, LABEL, VECTOR)
        rows = settle(rows.withColumn("weight", F.lit(1.0)))
        width = rows.select(F.size(vector_to_array(VECTOR))).first()
        if width is not None and width[0] <= self.most_features:
            self.names, self.members = list(names or []), boost(rows, width[0], self.rounds)
            return self
        # Row weights sum to 1 and C is 1, so the penalty is 1. It is put on scaled columns:
        # times and counts differ by orders of magnitude, and the fit would take far longer.
        regression = LogisticRegression(
            labelCol=LABEL, weightCol="weight", regParam=1.0, maxIter=self.max_iter
        )
        self.names, self.members = list(names or []), []
        for turn in range(1, self.rounds + 1):
            model = regression.fit(rows)
            member = (float(model.intercept), [float(x) for x in model.coefficients])
            missed = (F.col("prediction") != F.col(LABEL)).cast("double")
            tried = model.transform(rows).withColumn("_missed", missed)
            total, wrong = tried.agg(
                F.sum("weight"), F.sum(F.col("weight") * F.col("_missed"))
            ).first()
            error = wrong / total
            if error <= 0:
                self.members.append((1.0, *member))
                break
            if error >= 0.5:
                break
            strength = math.log((1 - error) / error)
            self.members.append((strength, *member))
            raised = F.col("weight") * F.exp(strength * F.col("_missed")) / F.lit(total)
            rows = tried.withColumn("weight", raised).select(STUDENT, LABEL, VECTOR, "weight")
            if turn % self.settle_every == 0:
                rows = settle(rows)
        if not self.members:
            # Not even the first round beat chance: keep it as the only voice.
            self.members.append((1.0, *member))
        return self

    def staged(self, rows: DataFrame, sizes: Sequence[int], *keep: str) -> DataFrame:
        """Probabilities by the first n rounds, an array with one for each of `sizes`."""
        strengths = np.array([m[0] for m in self.members])
        intercepts = np.array([m[1] for m in self.members])
        coefficients = np.array([m[2] for m in self.members]).reshape(len(self.members), -1).T
        last = np.minimum(np.array(sizes), len(self.members)) - 1
        whole = np.cumsum(strengths)
        chosen = vectorised(rows, self.names).select(STUDENT, *keep, VECTOR)

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = products(batch.column(VECTOR), coefficients) + intercepts
                sides = np.where(sums > 0, strengths, -strengths)
                decisions = np.cumsum(sides, axis=1)[:, last] / whole[last]
                staged = pa.array(list(1 / (1 + np.exp(-decisions))), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (STUDENT, *keep)], staged], [STUDENT, *keep, "staged"])

        kinds = dict(chosen.dtypes)
        return chosen.mapInArrow(vote, ", ".join(f"`{c}` {kinds[c]}" for c in (STUDENT, *keep)) + ", staged array<double>")

    def predict(self, rows: DataFrame, *keep: str) -> DataFrame:
        """Probability from the weighted vote of all rounds."""
        true = F.col("staged")[0]
        return self.staged(rows, [len(self.members)], *keep).select(
            STUDENT, *keep, (1 - true).alias("probability_false"), true.alias(PROBABILITY)
        )

    def save(self, spark: SparkSession, path: str) -> None:
        table = [(i, *member) for i, member in enumerate(self.members)]
        members = spark.createDataFrame(table, "round int, strength double, intercept double, coefficients array<double>")
        members.withColumn("names", F.array(*[F.lit(n) for n in self.names]).cast("array<string>")).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedRegression:
        saved = spark.read.parquet(path).orderBy("round").collect()  # one row per round
        model = cls(len(saved))
        model.names = list(saved[0]["names"])
        model.members = [(r["strength"], r["intercept"], list(r["coefficients"])) for r in saved]
        return model


def boosted_grid(
    data: DataFrame,
    names: Names,
    rounds: Sequence[int] = tuple(BOOSTING_ROUNDS),
    folds: int = CROSS_VALIDATION,
) -> DataFrame:
    """Cross-validated scores by number of boosting rounds.

    The first n rounds of a long run are the run of n rounds, so each fold is fitted once.
    """
    rows = settle(stratified_folds(data, folds))
    sizes = sorted(rounds)
    parts = []
    for fold in range(folds):
        model = BoostedRegression(sizes[-1]).fit(rows.where(F.col("fold") != fold), names)
        test = rows.where(F.col("fold") == fold).withColumn(TRUTH, F.col(LABEL).cast("int"))
        parts.append(model.staged(test, sizes, TRUTH, "fold"))
    predictions = settle(reduce(DataFrame.unionByName, parts))
    table = []
    for place, n in enumerate(sizes):
        found = predictions.withColumn(PROBABILITY, F.col("staged")[place])
        table.append((n, *(float(x or 0.0) for x in score(found).first())))
    columns = ["rounds", "adj_auc", "adj_kappa", "adj_score"]
    return data.sparkSession.createDataFrame(table, columns)


def best_boosted(data: DataFrame, names: Names, scores: DataFrame) -> BoostedRegression:
    """Fit the best number of rounds of the grid to all rows."""
    (rounds,) = best_setting(scores, ["rounds"])
    return BoostedRegression(rounds).fit(data, names)


def content_of(settings: str, *tables: DataFrame) -> str:
    """A digest of settings and of tables' rows, whatever their order and partitions."""
    parts = [settings]
    for table in tables:
        columns = sorted(table.columns)
        hashes = [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]
        sums = table.agg(F.count(F.lit(1)), *[F.sum(h.cast("decimal(38,0)")) for h in hashes]).first()
        parts.append(f"{columns} {tuple(str(x) for x in sums)}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def kept_with(path: str, content: str | None) -> bool:
    """Whether the model at `path` was trained on this content; any model will do for None."""
    spark = SparkSession.active()
    if content is None:
        return True
    note = f"{path}.content"
    return path_exists(spark, note) and spark.read.text(note).first()[0] == content


def keep_with(path: str, content: str | None, save: Callable[[], None]) -> None:
    """Save a model, and then what it was trained on: a save that fails half way leaves a model without that."""
    spark = SparkSession.active()
    delete(spark, f"{path}.content")
    save()
    if content is not None:
        spark.range(1).select(F.lit(content).alias("value")).coalesce(1).write.text(f"{path}.content")


def load_or_train_boosted(
    path: str, train: Callable[[], BoostedRegression], content: str | None = None
) -> BoostedRegression:
    """The boosted model saved at `path` for this content (`content_of`), or a newly trained one, which is saved there."""
    spark = SparkSession.active()
    if path_exists(spark, path) and kept_with(path, content):
        return BoostedRegression.load(spark, path)
    model = train()
    keep_with(path, content, lambda: model.save(spark, path))
    return model


def load_or_train(
    path: str, train: Callable[[], PipelineModel | GrownForest], content: str | None = None
) -> PipelineModel | GrownForest:
    """The model saved at `path` for this content (`content_of`), or a newly trained one, which is saved there."""
    spark = SparkSession.active()
    for part, load in (("metadata", PipelineModel.load), ("forest", lambda at: GrownForest.load(spark, at))):
        if path_exists(spark, f"{path}/{part}") and kept_with(path, content):
            return load(path)
    model = train()

    def save() -> None:
        # The other kind's files must not be found beside it.
        delete(spark, path)
        model.save(path) if isinstance(model, GrownForest) else model.write().overwrite().save(path)

    keep_with(path, content, save)
    return model
