from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from logloom.operators import behaviour, prepare, timing
from logloom.schema import ATTEMPT, ITEM, ITEM_TYPE, SEQ, STUDENT, VERB, VERB_RUN

CHAIN = behaviour.CHAIN


def chains_of(spark, counts: dict[str, int], item: str = "A"):
    data = [(n * 100 + i, item, 1, chain) for i, (chain, k) in enumerate(counts.items()) for n in range(k)]
    return spark.createDataFrame(data, f"{STUDENT} long, {ITEM} string, {ATTEMPT} int, {CHAIN} string")


def test_chain_is_sorted_and_distinct(make_log):
    log = make_log([(1, n, "A", v) for n, v in enumerate(["y", "x", "y", None])] + [(1, 9, "B", None)])
    found = rows(behaviour.verb_chains(prepare.preprocess(log)), ITEM, ATTEMPT, CHAIN)
    assert found == [("A", 1, "x,y")]


def test_tied_chains_are_taken_by_name(spark):
    chains = chains_of(spark, {f"c{n:02}": 21 for n in range(11)})
    top = behaviour.top_chains(chains)
    assert [r[0] for r in rows(top, CHAIN)] == [f"c{n:02}" for n in range(10)]


def test_support_must_be_exceeded(spark):
    chains = chains_of(spark, {"a": 21, "b": 20})
    assert rows(behaviour.top_chains(chains), CHAIN, "attempts") == [("a", 21)]
    common = behaviour.with_common_chains(chains)
    assert rows(common.groupBy(CHAIN).count()) == [("OtherActions", 20), ("a", 21)]


def test_rare_features_are_dropped(spark):
    chains = chains_of(spark, {"a": 21, "b": 9})
    found = behaviour.chain_features(chains)
    assert rows(found.groupBy("feature").agg(F.sum("value"))) == [("m_A_1_a", 21.0)]


def test_first_of_each_run(make_log):
    log = make_log([(1, 0, "A", "x"), (1, 1, "A", "x"), (1, 2, "A", "y"), (1, 3, "B", "y"), (1, 4, "B", "y")])
    first = behaviour.first_of_runs(prepare.preprocess(log))
    assert rows(first, ITEM, VERB_RUN, SEQ) == [("A", 1, 0), ("A", 2, 2), ("B", 1, 3)]


def test_padding(make_log):
    log = make_log([(1, n, "A", f"v{n}") for n in range(4)] + [(2, 0, "A", "v0")])
    tokens = behaviour.verb_time_tokens(prepare.preprocess(log))
    assert rows(tokens.where(F.col(STUDENT) == 2), "position", "token") == [(0, "A_v0_(0)")]
    spans = behaviour.padded_spans(tokens, {"token": ""})
    assert rows(spans.where(F.col(STUDENT) == 2), "start", "end", "token") == [(0, 0, "A_v0_(0)"), (1, 3, "")]
    assert spans.count() == 6
    found = behaviour.padded(tokens)
    assert found.count() == 8
    assert rows(found.where((F.col(STUDENT) == 2) & (F.col("position") > 0)), "token") == [("",)] * 3
    assert rows(found.groupBy(STUDENT).count().select("count").distinct()) == [(4,)]


def test_positions_between(spark):
    df = spark.createDataFrame([(1, 0, 25), (2, 7, 7), (3, 5, 4)], "k long, a long, b long")
    found = behaviour.positions_between(df.where("a <= b"), F.col("a"), F.col("b"), "n", block=10)
    assert rows(found.groupBy("k").agg(F.count("n"), F.min("n"), F.max("n"))) == [(1, 26, 0, 25), (2, 1, 7, 7)]


def test_minutes(make_log):
    log = make_log(
        [(1, 0, "A", "Draw"), (1, 1, "A", "Erase"), (1, 2, "A", "Yes"), (1, 185, "A", "Yes"), (2, 0, "A", "No"), (2, 1, "A", "No")]
    )
    events = behaviour.minute_events(log, below=10_000)
    summary = behaviour.minute_summary(events)
    series = behaviour.minute_series(summary)
    assert series.count() == 2 * 4
    names = ("minute", "verb_count", "unique_verb_count", "unique_verb_chain")
    one = rows(series.where(F.col(STUDENT) == 1), *names)
    assert one == [(0, 3, 2, '["Scratchwork","Yes"]'), (1, 0, 0, "0"), (2, 0, 0, "0"), (3, 1, 1, '["Yes"]')]
    spans = behaviour.minute_spans(summary)
    found = rows(spans, STUDENT, "start", "end", "verb_count")
    assert found == [(1, 0, 0, 3), (1, 1, 2, 0), (1, 3, 3, 1), (2, 0, 0, 2), (2, 1, 3, 0)]
    tensor = behaviour.minute_tensor(spans, block=3)
    assert rows(tensor.select(STUDENT, "block", F.size("minutes"))) == [(1, 0, 2), (1, 1, 1), (2, 0, 2)]


def test_one_long_student_pads_no_rows(spark):
    rows_ = [(s, n) for s in range(2, 200) for n in range(5)] + [(1, n) for n in range(20_000)]
    tokens = spark.createDataFrame([(s, n, "t") for s, n in rows_], "student_id long, position long, token string")
    assert behaviour.padded_spans(tokens, {"token": ""}).count() == len(rows_) + 198
    counts = [F.lit(x).alias(n) for n, x in (("duration_level", 1.0), ("verb_count", 1), ("unique_verb_count", 1))]
    summary = tokens.select(STUDENT, (F.col("position") * 50).alias("minute"), *counts, F.array(F.lit("v")).alias("unique_verbs"))
    assert behaviour.minute_spans(summary).count() <= 2 * len(rows_)


def test_long_actions_are_dropped(make_log):
    log = make_log([(1, 0, "A", "x"), (1, 1, "A", "x"), (1, 500, "A", "x")])
    levels = timing.with_duration_level(timing.with_verb_duration(log))
    kept = behaviour.minute_events(log)
    assert kept.count() == levels.where(F.col("duration_level") < 10).count() < 3
    assert ITEM_TYPE in kept.columns and VERB in kept.columns
