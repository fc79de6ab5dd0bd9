"""Code books, one-hot vectors and verb weights."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.clean import clean_log
from logloom.operators.codes import code_book, with_codes
from logloom.operators.series import MASKED, SECOND, weight_series
from logloom.operators.sparse import as_vectors, sparse_struct
from logloom.operators.timeline import MAX_ROWS, SLICE, cut, number_rows, settled
from logloom.operators.timing import VERB_DURATION, beside
from logloom.schema import (
    ITEM,
    LABEL,
    ORDER,
    RESPONSE_FEATURE_ITEMS,
    STUDENT,
    VERB,
    scope,
    subject,
)
from logloom.session import settle

WEIGHT = "verb_weight"
#: Weight of verbs the training log does not have, and number of weight classes.
NEUTRAL_WEIGHT = 4
WEIGHT_BINS = 6
NEWTON_STEPS = 60


def encoded_series(
    spans: DataFrame, columns: Sequence[str] = MASKED
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The spans of dense series with item, type and verb as codes, and the code books.

    Train and hidden rows of a batch share its books. "0", the mask, sorts first and so
    gets code 0.
    """
    sets = [c for c in scope(spans) if c != "task"]
    books = {c: code_book(spans, c, by=sets) for c in columns}
    coded = spans
    for column, book in books.items():
        coded = with_codes(coded, column, book)
    return coded, books


def encoding_dims(spans: DataFrame, columns: Sequence[str] = MASKED) -> DataFrame:
    """Number of classes of each encoded column, and of the verb weight."""
    sets = [c for c in scope(spans) if c != "task"]
    counts = spans.groupBy(*sets).agg(*[F.count_distinct(c).alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("feature_type"), F.col(c).alias("dim")) for c in columns]
    weight = F.struct(F.lit(WEIGHT).alias("feature_type"), F.lit(WEIGHT_BINS).cast("long").alias("dim"))
    return counts.select(*sets, F.inline(F.array(*rows, weight)))


def embedding_width(dim: Column) -> Column:
    """floor(sqrt(classes) / 2)."""
    return F.floor(F.sqrt(dim) / 2).cast("long")


@dataclass(frozen=True)
class OneHot:
    """Places of the values of some text columns: `book` has `position`, `value` and `code`, and `size` rows."""

    columns: Sequence[str]
    book: DataFrame
    size: int


def in_columns(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """`position` of the column and `value`, a row for each of `columns`."""
    cells = [F.struct(F.lit(i).alias("position"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)]
    return df.select(*keep, F.inline(F.array(*cells)))


def one_hot_model(df: DataFrame, columns: Sequence[str], max_rows: int = MAX_ROWS) -> OneHot:
    """Fits one-hot encoding of text columns; values unseen here, and nulls, become all zeros.

    The values of each column follow those of the columns before it, in sorted order. They stay in a table,
    which is numbered by slices if it outgrows a task.
    """
    # Text that sorts like (position, value).
    keyed = in_columns(df, columns).where("value IS NOT NULL").select(F.concat(F.lpad(F.col("position").cast("string"), 6, "0"), "value").alias("key"))
    book = code_book(keyed, "key", max_rows).select(
        F.substring("key", 1, 6).cast("int").alias("position"), F.expr("substring(key, 7)").alias("value"), F.col("code").cast("int").alias("code")
    )
    book = settle(book)
    return OneHot(tuple(columns), book, book.count())


def one_hot(model: OneHot, df: DataFrame, output: str = "features") -> DataFrame:
    """`df` with the sparse vector `output`, settled: codes by a join, vectors by an aggregation of one code per column."""
    numbered = settle(df.withColumn("_row", F.monotonically_increasing_id()))
    cells = in_columns(numbered, model.columns, "_row").where("value IS NOT NULL")
    codes = (
        cells.join(model.book, ["position", "value"])
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list("code")).alias("_codes"))
    )
    found = F.coalesce("_codes", F.array().cast("array<int>"))
    vector = sparse_struct(F.lit(model.size), found, F.transform(found, lambda _: F.lit(1.0)))
    whole = numbered.join(codes, "_row", "left").select(*[F.col(f"`{c}`") for c in df.columns], vector.alias(output))
    return as_vectors(whole, output)


def response_features(
    matrix: DataFrame, items: Sequence[str] = tuple(RESPONSE_FEATURE_ITEMS)
) -> tuple[OneHot, DataFrame]:
    """One-hot vectors of each student's answers to some items, and the fitted encoding."""
    model = one_hot_model(matrix, items)
    return model, one_hot(model, matrix.select(*subject(matrix), *items))


def equal_width_bins(df: DataFrame, column: str, bins: int = WEIGHT_BINS) -> DataFrame:
    """Replace a number by its class 1..bins of equal width; one value alone is class 1."""
    limits = df.agg(F.min(column).alias("_min"), F.max(column).alias("_max"))
    bounded = beside(df, limits, [])
    width = (F.col("_max") - F.col("_min")) / bins
    place = F.floor((F.col(column) - F.col("_min")) / width) + 1
    binned = F.when(width > 0, F.least(place, F.lit(bins))).otherwise(F.lit(1)).cast("int")
    return bounded.withColumn(column, binned).drop("_min", "_max")


def label_counts(clean: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Events of each (item, verb) by their student's label, `yes` and `no`, settled; per value of `by`, columns of `labels`."""
    events = (
        clean.where(F.col(ITEM).isNotNull() & F.col(VERB).isNotNull())
        .groupBy(STUDENT, ITEM, VERB)
        .count()
        .join(labels.select(STUDENT, LABEL, *by), STUDENT, "left")
        .where(F.col(LABEL).isNotNull())
    )
    count = F.col("count")
    return settle(
        events.groupBy(*by, ITEM, VERB).agg(
            F.coalesce(F.sum(F.when(F.col(LABEL), count)), F.lit(0)).alias("yes"),
            F.coalesce(F.sum(F.when(~F.col(LABEL), count)), F.lit(0)).alias("no"),
        )
    )


def balanced(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`positive` and `negative`: balanced weights of the events of each (item, verb) by label.

    Each label that occurs weighs as much as any other in total, and all events as many as they are.
    """
    totals = counts.groupBy(*by).agg(F.sum("yes").alias("_yes"), F.sum("no").alias("_no"))
    both = beside(counts, totals, by)
    labels_seen = (F.col("_yes") > 0).cast("int") + (F.col("_no") > 0).cast("int")
    share = {n: F.try_divide(F.col("_yes") + F.col("_no"), labels_seen * F.col(f"_{n}")) for n in ("yes", "no")}
    return both.select(
        *by,
        ITEM,
        VERB,
        F.coalesce(F.col("yes") * share["yes"], F.lit(0.0)).alias("positive"),
        F.coalesce(F.col("no") * share["no"], F.lit(0.0)).alias("negative"),
    )


def pair_counts(clean: DataFrame, labels: DataFrame) -> DataFrame:
    """`balanced` counts of all labelled events."""
    return balanced(label_counts(clean, labels))


def without_each_fold(counts: DataFrame) -> DataFrame:
    """Of counts by `fold`, those of all other folds: the total less the fold's own, pairs that are left with none aside."""
    folds = [F.lit(r["fold"]) for r in counts.select("fold").distinct().collect()]  # a row per fold
    totals = counts.groupBy(ITEM, VERB).agg(F.sum("yes").alias("_yes"), F.sum("no").alias("_no"))
    # One row per fold and pair; a pair that a fold lacks is whole outside it.
    grid = totals.withColumn("fold", F.explode(F.array(*folds).cast(f"array<{dict(counts.dtypes)['fold']}>")))
    own = grid.join(counts, ["fold", ITEM, VERB], "left").na.fill(0, ["yes", "no"])
    rest = own.select("fold", ITEM, VERB, (F.col("_yes") - F.col("yes")).alias("yes"), (F.col("_no") - F.col("no")).alias("no"))
    return settle(rest.where((F.col("yes") > 0) | (F.col("no") > 0)))


def pair_weight(intercept: Column, steps: int = NEWTON_STEPS) -> Column:
    """The best coefficient of a pair for a given intercept.

    Newton's method, from where the slope is steepest: it comes nearer with each step, from
    one side, and needs as many steps as the logarithm of the counts at most.
    """
    events = F.col("positive") + F.col("negative")

    def step(w: Column, _: Column) -> Column:
        p = 1 / (1 + F.exp(-(w + intercept)))
        return w - (events * p - F.col("positive") + w) / (events * p * (1 - p) + 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), -intercept, step)


def fitted_intercept(counts: DataFrame, tolerance: float = 1e-10, limit: int = 100) -> float:
    """The intercept at which it equals the sum of the coefficients, where the gradient is 0.

    One aggregate per step; nothing but two sums reaches the driver.
    """
    b, low, high = 0.0, float("-inf"), float("inf")
    for _ in range(limit):
        w = counts.select("positive", "negative", pair_weight(F.lit(b)).alias("w"))
        p = 1 / (1 + F.exp(-(F.col("w") + F.lit(b))))
        bend = (F.col("positive") + F.col("negative")) * p * (1 - p)
        total, slope = w.agg(F.sum("w"), F.sum(bend / (1 + bend))).first()
        gap = b - (total or 0.0)
        if abs(gap) <= tolerance * (1 + abs(b)):
            return b
        low, high = (low, b) if gap > 0 else (b, high)
        b = b - gap / (1 + slope)
        if not low < b < high:
            b = (low + high) / 2
    raise RuntimeError("the intercept does not settle")


def verb_weights(clean: DataFrame, labels: DataFrame) -> DataFrame:
    """How strongly each (item, verb) speaks for the label: a regression coefficient.

    Balanced logistic regression on one-hot (item, verb), penalised with C = 1 including the
    intercept. No event has two pairs, so each pair's coefficient is a problem of its own
    once the intercept is known, and pairs stay rows of a table.
    """
    counts = settle(pair_counts(clean, labels))
    intercept = fitted_intercept(counts)
    return counts.select(ITEM, VERB, pair_weight(F.lit(intercept)).alias(WEIGHT))


def fitted_intercepts(counts: DataFrame, tolerance: float = 1e-10, limit: int = 100) -> dict:
    """`fitted_intercept` of each fold, all of them in one aggregate per step."""
    state = {r["fold"]: (0.0, float("-inf"), float("inf")) for r in counts.select("fold").distinct().collect()}  # a row per fold
    done: dict = {}
    for _ in range(limit):
        here = F.lit(0.0)
        for fold, (b, _, _) in state.items():
            here = F.when(F.col("fold") == F.lit(fold), F.lit(b)).otherwise(here)
        left = [fold for fold in state if fold not in done]
        if not left:
            return done
        w = counts.where(F.col("fold").isin(left)).withColumn("b", here).withColumn("w", pair_weight(F.col("b")))
        p = 1 / (1 + F.exp(-(F.col("w") + F.col("b"))))
        bend = (F.col("positive") + F.col("negative")) * p * (1 - p)
        for r in w.groupBy("fold").agg(F.sum("w").alias("total"), F.sum(bend / (1 + bend)).alias("slope")).collect():
            b, low, high = state[r["fold"]]
            gap = b - r["total"]
            if abs(gap) <= tolerance * (1 + abs(b)):
                done[r["fold"]] = b
                continue
            low, high = (low, b) if gap > 0 else (b, high)
            b = b - gap / (1 + r["slope"])
            state[r["fold"]] = (b if low < b < high else (low + high) / 2, low, high)
    raise RuntimeError("an intercept does not settle")


def verb_weights_by_fold(clean: DataFrame, folds: DataFrame) -> DataFrame:
    """For each fold, the verb weights of the students outside it: (fold, item, verb, weight).

    `folds` has the students' label and `fold`. Events are counted once, by fold; what is outside a fold is the
    total less its own counts, and all folds' intercepts are found together.
    """
    counts = settle(balanced(without_each_fold(label_counts(clean, folds, ["fold"])), ["fold"]))
    intercept = F.lit(0.0)
    for fold, b in fitted_intercepts(counts).items():
        intercept = F.when(F.col("fold") == F.lit(fold), F.lit(b)).otherwise(intercept)
    return counts.select("fold", ITEM, VERB, pair_weight(intercept).alias(WEIGHT))


def verb_weight_map(clean: DataFrame, labels: DataFrame) -> DataFrame:
    """(item, verb) -> weight class 1..6."""
    return equal_width_bins(verb_weights(clean, labels), WEIGHT)


def with_weights(clean: DataFrame, weights: DataFrame) -> DataFrame:
    """Give each event its verb's weight, 4 where the map has none."""
    matched = clean.join(weights.select(ITEM, VERB, WEIGHT), [ITEM, VERB], "left")
    return matched.withColumn(WEIGHT, F.coalesce(WEIGHT, F.lit(NEUTRAL_WEIGHT)))


def weight_rows(log: DataFrame, weights: DataFrame, time_bin: int = 1, limit: int = 1800) -> DataFrame:
    """Raw events to their weights and durations, numbered along each student's time line."""
    series = weight_series(with_weights(clean_log(log), weights), time_bin, limit)
    return number_rows(settled(series))


def weights_of_bins(numbered: DataFrame, weights: DataFrame) -> DataFrame:
    """`weight_rows` of bins that have been numbered: `weights` has one row per item and verb."""
    kept = [c for c in (*subject(numbered), SLICE) if c in numbered.columns]
    weight = F.col(WEIGHT).cast("int").alias(WEIGHT)
    return with_weights(numbered, weights).select(*kept, *ORDER, SECOND, weight, VERB_DURATION, "position")
