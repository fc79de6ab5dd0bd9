from __future__ import annotations

import shutil

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logloom.operators import answers
from logloom.session import scratch, settle
from logloom.schema import INFO, ITEM, STUDENT, TIME, VERB
from logloom.sources import features, files, nested, submission

HEADER = "STUDENTID,AccessionNumber,ItemType,Observable,ExtendedInfo,EventTime"


def test_csv_log(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        f",{HEADER},FirstEntryEventTime,Duration\n"
        '0,7,VH1,MCSS,Math Keypress,"{""code"":""Digit1"",""partId"":""A""}",2017-04-04 10:00:01.25,x,1\n'
        "1,7,VH1,MCSS,Draw,,not a time,x,2\n"
    )
    log = files.read_log_csv(spark, str(path))
    first, second = log.orderBy("seq").collect()
    assert first[STUDENT] == 7 and first[INFO] == '{"code":"Digit1","partId":"A"}'
    assert first[TIME].microsecond == 250_000
    assert second[TIME] is None and second[INFO] is None


def test_ids_that_are_no_numbers_raise(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(f"{HEADER}\nseven,VH1,MCSS,Draw,,2017-04-04 10:00:00\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_log_csv(spark, str(path)).count()


def test_full_log_and_label_files(spark, tmp_path):
    (tmp_path / files.FULL_TRAIN_FILE).write_text(f"{HEADER}\n7,VH1,MCSS,Draw,,2017-04-04 10:00:00\n")
    for n, name in enumerate(files.LABEL_FILES.values()):
        (tmp_path / name).write_text(f"STUDENTID,EfficientlyCompletedBlockB\n{n},True\n")
    assert rows(files.read_training_log(spark, str(tmp_path)), STUDENT) == [(7,)]
    assert [rows(files.read_task_labels(spark, str(tmp_path), t)) for t in files.LABEL_FILES] == [[(0, True)], [(1, True)]]


def test_scratch_deletes_its_tables(spark):
    outer = settle(spark.range(3))
    with scratch(spark):
        inner = settle(spark.range(5))
        assert inner.count() == 5
    assert outer.count() == 3
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(inner.inputFiles()[0]).count()


def test_registered_files(spark, tmp_path):
    for (task, batch), name in files.BATCH_FILES.items():
        (tmp_path / name).write_text(f"{HEADER}\n{batch},VH1,MCSS,{task},,2017-04-04 10:00:00\n")
    log = files.read_batches(spark, str(tmp_path))
    assert rows(log, "task", "batch", STUDENT, VERB) == sorted(
        (task, batch, int(batch), task) for task, batch in files.BATCH_FILES
    )


def test_labels_and_roster(spark, tmp_path):
    (tmp_path / "l.csv").write_text("STUDENTID,EfficientlyCompletedBlockB\n1,True\n2,False\n")
    (tmp_path / "r.csv").write_text("STUDENTID\n9\n3\n5\n")
    assert rows(files.read_labels(spark, str(tmp_path / "l.csv"))) == [(1, True), (2, False)]
    roster = files.read_roster(spark, str(tmp_path / "r.csv")).orderBy("ord")
    assert [r[0] for r in roster.collect()] == [9, 3, 5]


def test_tables_are_foldered_by_task_and_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "10"), (2, "hidden", "20")], "student_id long, task string, batch string")
    for form in ("parquet", "csv"):
        path = str(tmp_path / form)
        files.write_table(df, path, form=form)
        back = spark.read.option("header", True).format(form).load(path)
        assert rows(back.select(F.col(STUDENT).cast("long"), "task", F.col("batch").cast("string"))) == rows(df)
        assert (tmp_path / form / "task=train" / "batch=10").is_dir()


def test_nested_documents_round_trip(spark, make_log, tmp_path):
    log = make_log([(1, n, "A", "Draw" if n else "Enter Item", f"i{n}") for n in range(25)] + [(2, 0, "B", "Draw")])
    roster = spark.createDataFrame([(1, True), (2, False), (3, None)], "student_id long, label boolean")
    documents = nested.student_logs(answers.in_force(log), roster, size=10)
    assert documents.agg(F.max(F.size("events"))).first()[0] == 10
    nested.write_student_logs(documents, str(tmp_path / "docs"))
    back = nested.read_student_logs(spark, str(tmp_path / "docs"))
    assert back.where(F.col(STUDENT) == 3).count() == 1
    found = nested.events_of(back).orderBy(STUDENT, "block", "place").collect()
    assert [r["info"] for r in found[:25]] == [f"i{n}" for n in range(25)]
    assert found[0]["label"] is True and found[25][ITEM] == "B"


def test_submission_round_trip(spark, tmp_path):
    df = spark.range(2000).select((1999 - F.col("id")).alias("ord"), (F.col("id") / 2000).alias(submission.PROBABILITY))
    path = tmp_path / "out"
    submission.write_submission(df, str(path))
    text = "".join(p.read_text() for p in sorted(path.glob("part-*")))
    lines = text.splitlines()
    assert len(lines) == 2000 and lines[0] == "0.9995," and lines[-1] == "0.0,"
    back = submission.read_submission(spark, str(path)).orderBy("file", "line", "place")
    assert [r[submission.PROBABILITY] for r in back.collect()] == [float(x[:-1]) for x in lines]
    (tmp_path / "one.csv").write_text("0.5,0.25,1.0,")
    one = submission.read_submission(spark, str(tmp_path / "one.csv")).orderBy("line", "place")
    assert [r[submission.PROBABILITY] for r in one.collect()] == [0.5, 0.25, 1.0]


def test_features_are_saved_and_read(spark, make_log, tmp_path):
    events = [(s, n * s, "AB"[n % 2], "xyz"[(n + s) % 3]) for s in range(1, 7) for n in range(4 + s % 2)]
    one = make_log(events).withColumn("task", F.when(F.col(STUDENT) % 3 == 0, "hidden").otherwise("train"))
    log = one.withColumn("batch", F.explode(F.array(F.lit("10"), F.lit("20"))))
    labels = spark.createDataFrame([(s, s % 2 == 0) for s in range(1, 7)], "student_id long, label boolean")
    folder = str(tmp_path / "saved")
    with pytest.raises(FileNotFoundError, match="run save_all first"):
        features.read_sequences(spark, folder, "10")
    with pytest.raises(FileNotFoundError, match="run save_all first"):
        features.read_dims(spark, folder, "10")
    features.save_all(log, labels, folder, limit=40, training_log=one.where("task = 'train'"))
    dims = dict(rows(features.read_dims(spark, folder, "10")))
    assert dims == {"item_id": 3, "item_type": 2, "observable": 4, "verb_weight": 6}
    weights = features.read_sequences(spark, folder, "20")
    assert rows(weights.select(F.size("values")).distinct()) == [(5,)]
    assert weights.count() == 6 * 2
    series = features.read_sequences(spark, folder, "10", ["item_id"])
    assert rows(series.select(F.size("values")).distinct()) == [(41,)]
    assert rows(series, "task", STUDENT)[0] == ("hidden", 3)


def test_a_save_that_fails_half_way_leaves_the_one_before(spark, make_log, tmp_path, monkeypatch):
    events = make_log([(s, n, "AB"[n % 2], "xyz"[n % 3]) for s in (1, 2) for n in range(10)])
    labels = spark.createDataFrame([(1, True), (2, False)], f"{STUDENT} long, label boolean")
    log = events.withColumn("task", F.when(F.col(STUDENT) == 1, "train").otherwise("hidden")).withColumn("batch", F.lit("10"))
    other = log.where(F.col(VERB) != "z")
    folder = str(tmp_path / "saved")

    def save(what):
        features.save_all(what, labels, folder, limit=12, training_log=events)

    save(log)
    before = rows(features.read_sequences(spark, folder, "10")), rows(features.read_dims(spark, folder, "10"))
    reader = features.read_dims(spark, folder, "10")
    assert features.damages(spark, folder).count() == 0
    write = features.write_table

    def failing(df, path, *more):
        if path.endswith(features.FEATURES):
            raise OSError("the disk is full")
        write(df, path, *more)

    monkeypatch.setattr(features, "write_table", failing)
    with pytest.raises(OSError, match="full"):
        save(other)
    assert (rows(features.read_sequences(spark, folder, "10")), rows(features.read_dims(spark, folder, "10"))) == before
    monkeypatch.setattr(features, "write_table", write)
    # A manifest whose writing was cut short doesn't count either.
    (tmp_path / "saved" / "manifest" / "7").mkdir()
    save(other)
    assert features.manifests(spark, folder) == [1, 2]
    after = rows(features.read_dims(spark, folder, "10"))
    assert after != before[1] and rows(reader) == before[1]
    assert features.prune(spark, folder) == 1 and features.manifests(spark, folder) == [2]
    assert rows(features.read_dims(spark, folder, "10")) == after
    # Files that don't hold what the manifest says.
    version = features.current(spark, folder).split("/")[-1]
    shutil.rmtree(tmp_path / "saved" / version / features.FEATURES / "task=train")
    assert features.damages(spark, folder).count() > 0
