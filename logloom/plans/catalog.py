"""The library's operators as queries over the test data, for checks and timing.

The event table stands for an event log through `sources.adapter`; see there for the scale
of time. Lists leave as joined text and numbers rounded, so that results can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.info import clean_info
from logloom.operators import answers as ans
from logloom.operators import behaviour as beh
from logloom.operators import encode as enc
from logloom.operators import limits as lim
from logloom.operators import prepare as prep
from logloom.operators import scoring as sco
from logloom.operators import series as ser
from logloom.operators import sparse as spr
from logloom.operators import timing as tim
from logloom.operators.clean import clean_log
from logloom.operators.timeline import cut, in_blocks, number_rows
from logloom.plans import folds
from logloom.plans import metrics as met
from logloom.plans import models as mod
from logloom.plans import routine as rou
from logloom.schema import (
    ATTEMPT,
    DURATION,
    INFO,
    ITEM,
    ITEM_TYPE,
    LABEL,
    SEQ,
    STUDENT,
    TIME,
    VERB,
    VERB_RUN,
)
from logloom.session import scratch_path, settle, tune
from logloom.sources import adapter
from logloom.sources.adapter import SECOND
from logloom.sources.features import read_dims, read_sequences, save_all
from logloom.sources.files import (
    SOURCE_COLUMNS,
    SOURCE_LABEL,
    read_labels,
    read_log_csv,
    read_roster,
    roster_in_batches,
    write_table,
)
from logloom.sources.nested import events_of, read_student_logs, student_logs, write_student_logs
from logloom.sources.submission import read_submission, submission_lines, write_submission

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY = 86_400
GRID = 1800


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(tune(spark), sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return run


def rounded(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def whole(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(adapter.event_log(spark, sf_dir))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.preprocess(event_log(spark, sf_dir))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tim.attempt_durations(numbered(spark, sf_dir))


# --- Preparation ----------------------------------------------------------------------


@query
def event_log_truncate(spark, sf_dir):
    batches = prep.cut_to_batches(event_log(spark, sf_dir), adapter.BATCH_LIMITS)
    return batches.select(STUDENT, SEQ, "batch")


@query
def nested_attempts(spark, sf_dir):
    """Attempts under every time limit, from one pass over the log."""
    found = lim.nested_attempts(event_log(spark, sf_dir), adapter.BATCH_LIMITS)
    return found.select("batch", STUDENT, ITEM, whole(ATTEMPT), rounded(DURATION), beh.CHAIN)


@query
def elapsed_time(spark, sf_dir):
    timed = prep.with_elapsed(event_log(spark, sf_dir))
    return timed.select(STUDENT, SEQ, F.round(F.col("elapsed_micros") / 1e6, 6).alias("elapsed"))


@query
def base_clean(spark, sf_dir):
    clean = prep.real_items(prep.base_clean(adapter.event_log(spark, sf_dir)), adapter.ITEMS)
    return clean.select(STUDENT, SEQ, ITEM, VERB)


@query
def verb_groups(spark, sf_dir):
    grouped = prep.group_verbs(adapter.event_log(spark, sf_dir))
    return grouped.select(STUDENT, SEQ, VERB)


@query
def attempt_index(spark, sf_dir):
    return numbered(spark, sf_dir).select(STUDENT, SEQ, ITEM, whole(ATTEMPT))


@query
def attempt_index_cut(spark, sf_dir):
    """The same with the logs of students of more than 100,000 events cut into slices."""
    log = cut(adapter.event_log(spark, sf_dir), max_rows=100_000)
    return prep.preprocess(log).select(STUDENT, SEQ, ITEM, whole(ATTEMPT), whole(VERB_RUN))


@query
def verb_run_index(spark, sf_dir):
    return numbered(spark, sf_dir).select(STUDENT, SEQ, whole(ATTEMPT), whole(VERB_RUN))


@query
def occur_minute(spark, sf_dir):
    clean = prep.base_clean(event_log(spark, sf_dir))
    return prep.with_occurrence(clean, "minute", DAY).select(STUDENT, SEQ, "minute")


# --- Times ----------------------------------------------------------------------------


@query
def attempt_duration(spark, sf_dir):
    """How long each student spent on each attempt at each item."""
    return durations(spark, sf_dir).select(STUDENT, ITEM, whole(ATTEMPT), rounded(DURATION))


def rounded_spreads(wide: DataFrame) -> DataFrame:
    """Round what depends on the order of additions; times and their means are exact."""
    inexact = [c for c in wide.columns if "_std_" in c or "scaled_" in c]
    return wide.withColumns({c: F.round(c, 6) for c in inexact})


@query
def attempt_duration_wide(spark, sf_dir):
    times = settle(durations(spark, sf_dir))
    name = F.concat_ws("_", F.lit("x"), ITEM, ATTEMPT)
    return rounded_spreads(tim.widen(tim.melt(times, [STUDENT], name, [DURATION])))


STATS = ["attempt_times", "attempt_mean_time", "attempt_min_time"]


@query
def item_attempt_stats(spark, sf_dir):
    stats = tim.item_attempt_stats(durations(spark, sf_dir))
    return stats.select(STUDENT, ITEM, *STATS)


@query
def item_attempt_stats_wide(spark, sf_dir):
    stats = tim.item_attempt_stats(durations(spark, sf_dir))
    name = F.concat_ws("_", F.lit("y"), "measure", ITEM)
    names = sorted(f"y_{m}_{i}" for m in STATS for i in adapter.ITEMS)
    return rounded_spreads(tim.widen(tim.melt(stats, [STUDENT], name, STATS), names))


@query
def item_duration_stats(spark, sf_dir):
    stats = tim.item_duration_stats(durations(spark, sf_dir), adapter.ITEMS)
    return stats.select(ITEM, "item_mean", rounded("item_std"))


@query
def item_zscore(spark, sf_dir):
    scores = tim.with_zscore(durations(spark, sf_dir), adapter.ITEMS)
    return scores.select(STUDENT, ITEM, whole(ATTEMPT), rounded("z"))


@query
def item_zscore_fitted(spark, sf_dir):
    """Hidden students against the attempts of the training students."""
    times = settle(durations(spark, sf_dir))
    fitted = tim.item_duration_stats(times.where(adapter.is_train()), adapter.ITEMS)
    scores = tim.with_zscore(times.where(~adapter.is_train()), adapter.ITEMS, fitted)
    return scores.select(STUDENT, ITEM, whole(ATTEMPT), rounded("z"))


@query
def item_zscore_merged(spark, sf_dir):
    """Hidden students against the training students' attempts, of which only three merged states are kept."""
    times = settle(durations(spark, sf_dir))
    train = times.where(adapter.is_train())
    states = [settle(tim.item_duration_state(train.where(F.col(STUDENT) % 3 == k), adapter.ITEMS)) for k in range(3)]
    merged = tim.merged_states(tim.merged_states(*states[:2]), states[2])
    scores = tim.with_zscore(times.where(~adapter.is_train()), adapter.ITEMS, tim.stats_of_state(merged))
    return scores.select(STUDENT, ITEM, whole(ATTEMPT), rounded("z"))


@query
def student_time_stats(spark, sf_dir):
    scores = tim.with_zscore(durations(spark, sf_dir), adapter.ITEMS)
    return rounded_spreads(tim.student_time_stats(scores, adapter.ITEMS))


@query
def time_features(spark, sf_dir):
    long = settle(tim.time_features(event_log(spark, sf_dir), adapter.ITEMS))
    return rounded_spreads(tim.widen(long))


@query
def verb_duration(spark, sf_dir):
    timed = tim.with_verb_duration(prep.base_clean(event_log(spark, sf_dir)))
    return timed.select(STUDENT, SEQ, rounded("verb_duration"))


@query
def duration_level(spark, sf_dir):
    timed = tim.with_verb_duration(prep.base_clean(event_log(spark, sf_dir)))
    return tim.with_duration_level(timed).select(STUDENT, SEQ, "duration_level")


@query
def duration_level_by_verb(spark, sf_dir):
    timed = tim.with_verb_duration(prep.base_clean(event_log(spark, sf_dir)))
    levels = tim.with_duration_level(timed, by=[ITEM, VERB])
    return levels.select(STUDENT, SEQ, "duration_level")


# --- Behaviour ------------------------------------------------------------------------


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beh.verb_chains(numbered(spark, sf_dir))


@query
def verb_chain(spark, sf_dir):
    return chains(spark, sf_dir).select(STUDENT, ITEM, whole(ATTEMPT), "verb_chain")


@query
def chain_counts(spark, sf_dir):
    return beh.chain_counts(chains(spark, sf_dir))


@query
def top_verb_chains(spark, sf_dir):
    return beh.top_chains(chains(spark, sf_dir)).select(ITEM, "verb_chain", "attempts", whole("rank"))


@query
def common_verb_chains(spark, sf_dir):
    common = beh.with_common_chains(chains(spark, sf_dir))
    return common.select(STUDENT, ITEM, whole(ATTEMPT), "verb_chain")


@query
def chain_features(spark, sf_dir):
    features = beh.behaviour_features(event_log(spark, sf_dir))
    return features.select(STUDENT, "feature", "value")


@query
def first_of_verb_run(spark, sf_dir):
    first = beh.first_of_runs(numbered(spark, sf_dir))
    return first.select(STUDENT, ITEM, whole(ATTEMPT), whole(VERB_RUN), SEQ, VERB)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beh.verb_time_tokens(numbered(spark, sf_dir))


@query
def verb_time_tokens(spark, sf_dir):
    return tokens(spark, sf_dir).select(STUDENT, "position", "token")


@query
def verb_time_padded(spark, sf_dir):
    """Token sequences of one length: a student's tokens, and a span of fillers."""
    return beh.padded_spans(settle(tokens(spark, sf_dir)), {"token": ""})


@query
def verb_time_codes(spark, sf_dir):
    """Each student's padded token sequence as codes, in blocks; a span is code x length."""
    spans_ = settle(beh.padded_spans(settle(tokens(spark, sf_dir)), {"token": ""}))
    coded = enc.with_codes(spans_, "token", enc.code_book(spans_, "token"))
    cell = F.concat_ws("x", F.col("token"), F.col("end") - F.col("start") + 1)
    blocks = in_blocks(coded, [STUDENT], cell, name="codes", position="start")
    return blocks.select(STUDENT, "block", F.array_join("codes", " ").alias("codes"))


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beh.minute_events(event_log(spark, sf_dir), DAY)


@query
def minute_summary(spark, sf_dir):
    summary = beh.minute_summary(minutes(spark, sf_dir))
    return summary.withColumn("unique_verbs", F.array_join("unique_verbs", ","))


@query
def minute_lists(spark, sf_dir):
    """Verbs and item types of each minute in order."""
    rows = number_rows(minutes(spark, sf_dir))
    both = F.concat(VERB, F.lit("/"), ITEM_TYPE)
    lists = in_blocks(rows, [STUDENT, "minute"], both, name="verbs")
    return lists.select(STUDENT, "minute", "block", F.array_join("verbs", ",").alias("verbs"))


@query
def minute_series(spark, sf_dir):
    """Every student's minutes, stretches without events as one span each."""
    return beh.minute_spans(settle(beh.minute_summary(minutes(spark, sf_dir))))


@query
def minute_codes(spark, sf_dir):
    """The minute series with verb lists as codes, all numbers."""
    series = settle(beh.minute_spans(settle(beh.minute_summary(minutes(spark, sf_dir)))))
    book = enc.code_book(series, "unique_verb_chain")
    return enc.with_codes(series, "unique_verb_chain", book)


@query
def minute_tensor(spark, sf_dir):
    series = beh.minute_spans(settle(beh.minute_summary(minutes(spark, sf_dir))))
    cell = lambda m: F.concat_ws(
        ":", m["start"], m["end"], m["duration_level"].cast("long"), m["verb_count"], m["unique_verb_count"], m["unique_verb_chain"]
    )
    text = F.array_join(F.transform("minutes", cell), ";")
    return beh.minute_tensor(series).select(STUDENT, "block", text.alias("minutes"))


# --- Series ---------------------------------------------------------------------------


@query
def clean_extended_info(spark, sf_dir):
    return clean_log(adapter.event_log(spark, sf_dir)).select(STUDENT, SEQ, ITEM, ITEM_TYPE, VERB)


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ser.second_bins(clean_log(event_log(spark, sf_dir)), SECOND, GRID * SECOND)


@query
def second_bins(spark, sf_dir):
    return bins(spark, sf_dir).select(STUDENT, SEQ, "occur_second", "verb_duration")


@query
def last_per_second(spark, sf_dir):
    last = ser.last_per_second(bins(spark, sf_dir))
    return last.select(STUDENT, "occur_second", ITEM, ITEM_TYPE, VERB, "verb_duration")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ser.second_series(event_log(spark, sf_dir), SECOND, GRID * SECOND)


@query
def dense_series(spark, sf_dir):
    return ser.dense_rows(spans(spark, sf_dir)).select(
        STUDENT, "occur_second", ITEM, ITEM_TYPE, VERB, "verb_duration"
    )


@query
def series_arrays(spark, sf_dir):
    arrays = ser.series_arrays(spans(spark, sf_dir), [ITEM, VERB])
    return arrays.select(STUDENT, *[F.array_join(c, ",").alias(c) for c in (ITEM, VERB)])


@query
def encoding_dims(spark, sf_dir):
    return enc.encoding_dims(spans(spark, sf_dir)).select(
        "feature_type", whole("dim"), enc.embedding_width(F.col("dim")).alias("width")
    )


@query
def encoded_series(spark, sf_dir):
    """Label-encoded series of all students, train and hidden, with shared codes."""
    coded, _ = enc.encoded_series(settle(spans(spark, sf_dir)))
    arrays = ser.series_arrays(coded, [ITEM, ITEM_TYPE, VERB])
    text = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in (ITEM, ITEM_TYPE, VERB)]
    return arrays.select(STUDENT, *text)


@query
def stacked_series(spark, sf_dir):
    arrays = settle(ser.series_arrays(spans(spark, sf_dir), [ITEM, ITEM_TYPE]))
    stack = ser.stacked({c: arrays.select(STUDENT, c) for c in (ITEM, ITEM_TYPE)})
    cell = lambda s: F.concat_ws("/", s[ITEM], s[ITEM_TYPE])
    return stack.select(STUDENT, F.array_join(F.transform("series", cell), ",").alias("series"))


# --- Sources and back -----------------------------------------------------------------


@query
def log_csv(spark, sf_dir):
    """The log written as the source's CSV and read again."""
    path = scratch_path(spark)
    named = [F.col(c).cast("string").alias(name) for c, name in SOURCE_COLUMNS.items()]
    adapter.event_log(spark, sf_dir).select(*named).write.option("header", True).option("escape", '"').csv(path)
    return read_log_csv(spark, path).select(STUDENT, ITEM, ITEM_TYPE, VERB, INFO, TIME)


@query
def labels_csv(spark, sf_dir):
    """Labels and roster written as the source's CSV and read again; the roster keeps the order of its file."""
    paths = [scratch_path(spark) for _ in range(2)]
    student = F.col(STUDENT).cast("string").alias(SOURCE_COLUMNS[STUDENT])
    labels, roster = adapter.labels(spark, sf_dir), adapter.roster(spark, sf_dir)
    labels.select(student, F.col(LABEL).alias(SOURCE_LABEL)).write.option("header", True).csv(paths[0])
    ordered = roster.repartitionByRange(1, F.desc(STUDENT)).sortWithinPartitions(F.desc(STUDENT))
    ordered.select(student).write.option("header", True).csv(paths[1])
    placed = number_rows(read_roster(spark, paths[1]).withColumn("file", F.lit(0)), by=["file"], order=["ord"])
    return read_labels(spark, paths[0]).join(placed, STUDENT).select(STUDENT, LABEL, "position")


@query
def partitioned_table(spark, sf_dir):
    """Attempts of all batches in folders by task and batch, written and read again: rows and seconds of each."""
    path = scratch_path(spark)
    attempts = lim.nested_attempts(adapter.with_task(event_log(spark, sf_dir)), adapter.BATCH_LIMITS, verbs=False)
    write_table(attempts, path)
    saved = spark.read.parquet(path)
    micros = (F.col(DURATION).cast("decimal(22,6)") * 1_000_000).cast("long")
    return saved.groupBy("task", F.col("batch").cast("string").alias("batch"), ITEM).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum(micros).alias("micros")
    )


@query
def eliminated_choices(spark, sf_dir):
    """The log with clicks as eliminated options: how often each one is."""
    log = adapter.event_log(spark, sf_dir).where(F.col(VERB) == "Click Choice").withColumn(VERB, F.lit("Eliminate Choice"))
    return log.groupBy(ITEM, clean_info(F.col(VERB), F.col(INFO)).alias("option")).agg(F.count(F.lit(1)).alias("events"))


@query
def nested_json(spark, sf_dir):
    """The nested documents written as JSON, read and unfolded again."""
    path = scratch_path(spark)
    write_student_logs(student_logs(placed(spark, sf_dir)), path)
    rows = events_of(read_student_logs(spark, path))
    return rows.select(STUDENT, ITEM, "block", whole("place"), "action", "info", "time")


@query
def submission_file(spark, sf_dir):
    """A submission written and read again: how often each probability occurs."""
    path = scratch_path(spark)
    write_submission(rou.on_roster(adapter.roster(spark, sf_dir), guesses(spark, sf_dir)), path)
    return read_submission(spark, path).groupBy(met.PROBABILITY).agg(F.count(F.lit(1)).alias("lines"))


def saved(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark)
    log = adapter.event_log(spark, sf_dir)
    one_batch = adapter.with_task(log).withColumn("batch", F.lit("30"))
    train = log.where(adapter.is_train())
    save_all(one_batch, adapter.labels(spark, sf_dir), path, SECOND, GRID * SECOND, training_log=train)
    return path


@query
def saved_series(spark, sf_dir):
    """Item codes and verb weights of one batch, saved and read again."""
    found = read_sequences(spark, saved(spark, sf_dir), "30", [ITEM, "verb_weight"])
    text = F.array_join(F.transform("values", lambda v: v.cast("long").cast("string")), " ")
    return found.select("task", STUDENT, "feature", "block", text.alias("series"))


@query
def saved_dims(spark, sf_dir):
    return read_dims(spark, saved(spark, sf_dir), "30").select("feature_type", whole("dim"))


# --- Answers and scores ---------------------------------------------------------------


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ans.in_force(event_log(spark, sf_dir))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ans.with_visits(placed(spark, sf_dir))


@query
def item_in_force(spark, sf_dir):
    return placed(spark, sf_dir).select(STUDENT, SEQ, ITEM)


@query
def attempt_split(spark, sf_dir):
    return ans.visit_events(visits(spark, sf_dir)).select(STUDENT, SEQ, ITEM, whole("visit"))


@query
def student_item_logs(spark, sf_dir):
    documents = student_logs(placed(spark, sf_dir), adapter.labels(spark, sf_dir))
    line = lambda e: F.concat_ws("|", e["action"], e["info"])
    return documents.select(
        STUDENT, LABEL, ITEM, "block", F.array_join(F.transform("events", line), ";").alias("events")
    )


@query
def student_item_events(spark, sf_dir):
    """The nested documents unfolded again."""
    rows = events_of(student_logs(placed(spark, sf_dir)))
    return rows.select(STUDENT, ITEM, "block", whole("place"), "action", "info")


def slots_text(found: DataFrame) -> DataFrame:
    text = F.transform("slots", lambda s: F.coalesce(s, F.lit("-")))
    return found.select(STUDENT, ITEM, F.array_join(text, "|").alias("answer"))


@query
def answer_choice(spark, sf_dir):
    return slots_text(ans.choice_answers(visits(spark, sf_dir)))


def blanks_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    key = {i: v for i, v in adapter.ANSWERS.items() if v[0] == kind}
    return slots_text(ans.blank_answers(visits(spark, sf_dir), key))


@query
def answer_blank(spark, sf_dir):
    return blanks_of(spark, sf_dir, "blank")


@query
def answer_multi_blank(spark, sf_dir):
    return blanks_of(spark, sf_dir, "blanks")


@query
def answer_composite(spark, sf_dir):
    return blanks_of(spark, sf_dir, "composite")


@query
def answer_match(spark, sf_dir):
    return slots_text(ans.match_answers(visits(spark, sf_dir)))


def responses(spark: SparkSession, sf_dir: str, key=adapter.ANSWERS) -> DataFrame:
    return ans.responses(event_log(spark, sf_dir), adapter.labels(spark, sf_dir), key)


@query
def response_matrix(spark, sf_dir):
    return ans.response_matrix(responses(spark, sf_dir), adapter.ANSWERS)


@query
def score_long(spark, sf_dir):
    scores = sco.scored(responses(spark, sf_dir), adapter.ANSWERS)
    return scores.select(STUDENT, ITEM, "status", whole("score"))


@query
def score_matrix(spark, sf_dir):
    scores = sco.scored(responses(spark, sf_dir), adapter.ANSWERS)
    return sco.score_matrix(scores, adapter.ANSWERS)


@query
def score_all_batches(spark, sf_dir):
    """Scores of the three batches of train and hidden students in one job."""
    log = adapter.with_task(event_log(spark, sf_dir))
    roster = adapter.with_task(adapter.labels(spark, sf_dir))
    rosters = roster_in_batches(roster, list(adapter.BATCH_LIMITS))
    found = ans.responses(log, rosters, adapter.ANSWERS, limits=adapter.BATCH_LIMITS)
    return sco.score_matrix(sco.scored(found, adapter.ANSWERS), adapter.ANSWERS)


@query
def item_right_share(spark, sf_dir):
    key = adapter.CHOICE_ANSWERS
    shares = sco.item_right_share(sco.scored(responses(spark, sf_dir, key), key))
    return shares.select(ITEM, "answered", rounded("right_share"))


@query
def conditional_option_share(spark, sf_dir):
    key = adapter.CHOICE_ANSWERS
    scores = settle(sco.scored(responses(spark, sf_dir, key), key))
    shares = sco.conditional_option_share(scores, easiest=1)
    return shares.select(ITEM, "option", "students", whole("is_right"), "answered", rounded("share"))


@query
def item_right_share_mixed(spark, sf_dir):
    """Right means all slots right, with items of one to five slots."""
    scores = sco.scored(responses(spark, sf_dir), adapter.ANSWERS)
    return sco.item_right_share(scores).select(ITEM, "answered", rounded("right_share"))


@query
def conditional_option_share_mixed(spark, sf_dir):
    """Answers of the students who got the two easiest items all right; one item has four slots."""
    key = {**adapter.CHOICE_ANSWERS, "IT03": adapter.ANSWERS["IT03"]}
    scores = settle(sco.scored(responses(spark, sf_dir, key), key))
    shares = sco.conditional_option_share(scores, easiest=2)
    return shares.select(ITEM, "option", "students", whole("is_right"), "answered", rounded("share"))


# --- Encoders -------------------------------------------------------------------------


@query
def label_encode(spark, sf_dir):
    return enc.code_book(clean_log(adapter.event_log(spark, sf_dir)), VERB)


@query
def label_encode_cut(spark, sf_dir):
    """The same with a vocabulary of more than 100,000 words numbered slice by slice."""
    return enc.code_book(clean_log(adapter.event_log(spark, sf_dir)), VERB, max_rows=100_000)


@query
def one_hot(spark, sf_dir):
    """One-hot answers: fitted on train students, values only hidden ones have are zeros."""
    key = adapter.CHOICE_ANSWERS
    matrix = settle(ans.response_matrix(responses(spark, sf_dir, key), key))
    model = enc.one_hot_model(matrix.where(adapter.is_train()), adapter.ITEMS[:2])
    encoded = enc.one_hot(model, matrix)
    bits = F.transform(mod.vector_to_array("features"), lambda x: x.cast("int").cast("string"))
    return encoded.select(STUDENT, F.array_join(bits, "").alias("features"))


@query
def response_features(spark, sf_dir):
    """One-hot answers of all students to three items, fitted on the same answers."""
    key = adapter.CHOICE_ANSWERS
    matrix = settle(ans.response_matrix(responses(spark, sf_dir, key), key))
    _, encoded = enc.response_features(matrix, adapter.ITEMS[1:])
    bits = F.transform(mod.vector_to_array("features"), lambda x: x.cast("int").cast("string"))
    return encoded.select(STUDENT, F.array_join(bits, "").alias("features"))


def pair_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = clean_log(adapter.event_log(spark, sf_dir))
    return (
        mod.labelled(clean, adapter.labels(spark, sf_dir))
        .groupBy(ITEM, VERB)
        .agg(F.avg(F.col(LABEL).cast("int")).alias("verb_weight"))
    )


@query
def weight_bins(spark, sf_dir):
    """Six classes of equal width, of each verb's share of labelled events."""
    binned = enc.equal_width_bins(settle(pair_rates(spark, sf_dir)), "verb_weight")
    return binned.select(ITEM, VERB, whole("verb_weight"))


@query
def weight_rows(spark, sf_dir):
    """Events with the weight class of their verb, 4 where the map lacks it."""
    binned = enc.equal_width_bins(settle(pair_rates(spark, sf_dir)), "verb_weight")
    known = settle(binned.where(F.col(ITEM) != "IT03"))
    rows = enc.weight_rows(event_log(spark, sf_dir), known, SECOND, GRID * SECOND)
    return rows.select(STUDENT, "position", whole("verb_weight"), "verb_duration")


@query
def verb_weight_map(spark, sf_dir):
    """Weight classes of verbs from a regression on the training students' events."""
    log = adapter.event_log(spark, sf_dir).where(adapter.is_train())
    return enc.verb_weight_map(clean_log(log), adapter.labels(spark, sf_dir))


@query
def verb_weights_by_fold(spark, sf_dir):
    """Verb weights of the students outside each of three folds, from one count by fold."""
    log = adapter.event_log(spark, sf_dir).where(adapter.is_train())
    folds = adapter.labels(spark, sf_dir).withColumn("fold", F.floor(F.col(STUDENT) / 2).cast("int") % 3)
    found = enc.verb_weights_by_fold(clean_log(log), folds)
    return found.select("fold", ITEM, VERB, F.round("verb_weight", 5).alias("verb_weight"))


@query
def weight_sequences(spark, sf_dir):
    """Weight and duration sequences of all students, padded to the longest."""
    log = adapter.event_log(spark, sf_dir)
    train = clean_log(log.where(adapter.is_train()))
    weights = settle(enc.verb_weight_map(train, adapter.labels(spark, sf_dir)))
    rows = settle(enc.weight_rows(cut(log), weights, SECOND, GRID * SECOND))
    return beh.padded_spans(rows, {"verb_weight": 0, "verb_duration": 0.0})


# --- Training and metrics -------------------------------------------------------------


@query
def labelled_events(spark, sf_dir):
    """Events of each verb by label of their student."""
    events = adapter.event_log(spark, sf_dir)
    joined = events.join(adapter.labels(spark, sf_dir).where(adapter.is_train()), STUDENT, "left")
    return joined.groupBy(VERB, LABEL).agg(F.count(F.lit(1)).alias("events"))


def feature_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = event_log(spark, sf_dir)
    sets = (log.where(adapter.is_train()), log.where(~adapter.is_train()))
    return tuple(settle(tim.time_features(s, adapter.ITEMS)) for s in sets)


@query
def common_features(spark, sf_dir):
    """Chain features that both train and hidden students show."""
    log = event_log(spark, sf_dir)
    sets = (log.where(adapter.is_train()), log.where(~adapter.is_train()))
    train, hidden = mod.common_features(*(settle(beh.behaviour_features(s)) for s in sets))
    return train.unionByName(hidden).select(STUDENT, "feature", "value")


@query
def train_features(spark, sf_dir):
    """Labelled students with the features that hidden ones have too, a column each."""
    train, _ = mod.common_features(*feature_sets(spark, sf_dir))
    names = tim.feature_names(train)
    wide = mod.labelled(tim.widen(train, names).fillna(0.0, names), adapter.labels(spark, sf_dir))
    return rounded_spreads(wide.select(STUDENT, LABEL, *names))


@query
def sparse_features(spark, sf_dir):
    """All entries of the train students' vectors of time features, written as vectors and read back."""
    rows, _, index = training(spark, sf_dir)
    found = spr.entries(rows).join(index.select(F.col("index").cast("int").alias("index"), "feature"), "index")
    inexact = F.col("feature").contains("_std_") | F.col("feature").contains("scaled_")
    value = F.when(inexact, F.round("value", 6)).otherwise(F.col("value")).alias("value")
    return found.select(STUDENT, LABEL, "index", "feature", value).where("value != 0")


def guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for predictions that plain SQL can compute: from the number of events."""
    counts = adapter.event_log(spark, sf_dir).groupBy(STUDENT).agg(F.count(F.lit(1)).alias("_n"))
    guess = ((F.col("_n") * 37 + F.col(STUDENT) * 53) % 101) / F.lit(100.0)
    return counts.select(
        STUDENT,
        guess.alias(met.PROBABILITY),
        (F.col(STUDENT) % 2).cast("int").alias(met.TRUTH),
        (F.col(STUDENT) % 3).alias("fold"),
    )


@query
def submission(spark, sf_dir):
    """The lines of a submission; students without a prediction get 0."""
    parts = [guesses(spark, sf_dir).where(F.col(STUDENT) % 4 == r) for r in (0, 2, 3)]
    found = rou.stack_predictions([p.select(STUDENT, met.PROBABILITY) for p in parts])
    return submission_lines(rou.on_roster(adapter.roster(spark, sf_dir), found))


@query
def stratified_folds(spark, sf_dir):
    return folds.stratified_folds(adapter.labels(spark, sf_dir), 3).select(STUDENT, LABEL, whole("fold"))


@query
def hash_split(spark, sf_dir):
    students = adapter.roster(spark, sf_dir)
    return students.select(STUDENT, folds.hash_split(F.col(STUDENT), 0.2, seed=8).alias("validation"))


@query
def metrics_auc(spark, sf_dir):
    scores = met.rank_auc(guesses(spark, sf_dir), ["fold"])
    return scores.select("fold", rounded("auc"))


@query
def metrics_kappa(spark, sf_dir):
    scores = met.with_kappa(met.confusion(guesses(spark, sf_dir), ["fold"]))
    return scores.select("fold", "tn", "fp", "fn", "tp", rounded("accuracy"), rounded("kappa"))


@query
def metrics_adjusted(spark, sf_dir):
    return rounded_columns(mod.score(guesses(spark, sf_dir)))


@query
def metrics_accuracy(spark, sf_dir):
    return met.accuracy(guesses(spark, sf_dir)).select("students", "right", rounded("accuracy"))


@query
def metrics_by_fold(spark, sf_dir):
    scores = mod.fold_metrics(guesses(spark, sf_dir))
    return scores.select("fold", *[rounded(c) for c in ("loss", "accuracy", "auc", "kappa")])


def rounded_columns(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(c) for c in df.columns])


@query
def describe(spark, sf_dir):
    stats = met.describe(durations(spark, sf_dir), [DURATION])
    # Quartiles lie between two values of six digits: rounding to six would meet halves.
    return stats.select("column", "count", *[F.round(c, 4).alias(c) for c in stats.columns[2:]])


def training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return mod.training_tables(*feature_sets(spark, sf_dir), adapter.labels(spark, sf_dir))


@query
def rf_predict(spark, sf_dir):
    train, hidden, _ = training(spark, sf_dir)
    _, found = mod.fit_predict(train, hidden, None, mod.random_forest(20))
    return found


@query
def rf_grid(spark, sf_dir):
    train, _, _ = training(spark, sf_dir)
    return mod.forest_grid(train, None, trees=[5, 15, 30])


@query
def forest_prefix_votes(spark, sf_dir):
    """Scores by number of trees, from votes of student and tree that plain SQL can compute."""
    students = guesses(spark, sf_dir)
    drawn = (F.col(STUDENT) * 31 + F.col("tree") * F.col("tree") * 17 + F.col("tree") * 7) % 97
    # Parts of 128: their sums are exact in any order.
    leaning = (drawn + F.col(met.TRUTH) * 31) / F.lit(128.0)
    votes = students.select(STUDENT, met.TRUTH, "fold", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("tree"))
    found = settle(mod.prefix_predictions(votes.withColumn("p", leaning), [5, 15, 30], met.TRUTH, "fold"))
    parts = [mod.score(found.where(F.col("trees") == n)).select(F.lit(n).alias("trees"), "*") for n in (5, 15, 30)]
    joined = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return joined.select(whole("trees"), *[rounded(c) for c in joined.columns[1:]])


@query
def best_grid_setting(spark, sf_dir):
    """The best number of trees of `forest_prefix_votes`; of equal scores the smallest."""
    scores = forest_prefix_votes(spark, sf_dir).withColumn("feature_fraction", F.lit(0.3))
    trees, fraction = mod.best_setting(scores, mod.FOREST_PARAMETERS)
    return scores.where((F.col("trees") == trees) & (F.col("feature_fraction") == fraction)).select("trees", "feature_fraction")


@query
def boosted_lr(spark, sf_dir):
    """Up to 2,500 rounds; boosting ends at a round that is no better than chance."""
    train, hidden, _ = training(spark, sf_dir)
    return mod.BoostedRegression(mod.BOOSTING_ROUNDS[-1]).fit(train, None).predict(hidden)


@query
def fold_metrics(spark, sf_dir):
    train, _, _ = training(spark, sf_dir)
    folded = settle(folds.stratified_folds(train, 2, seed=8))
    found = mod.cross_predictions(folded, None, mod.random_forest(10))
    return mod.fold_metrics(settle(found))


@query
def routine_submission(spark, sf_dir):
    """Per batch the grid search and its best forest, each hidden student in one batch, then the submission."""
    log = adapter.with_task(event_log(spark, sf_dir))
    batches = F.array(*[F.lit(b) for b in adapter.BATCH_LIMITS])
    own = F.col("batch") == F.element_at(batches, (F.floor(F.col(STUDENT) / 4) % 3 + 1).cast("int"))
    features = rou.nested_features(log, adapter.BATCH_LIMITS, adapter.ITEMS, adapter.is_train() | own)
    found = rou.predict_batches(features, adapter.labels(spark, sf_dir))
    hidden = adapter.roster(spark, sf_dir).where(~adapter.is_train())
    return submission_lines(rou.on_roster(hidden, found))
