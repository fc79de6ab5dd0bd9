"""Every query against its SQL in DuckDB, on the smallest test data."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from logloom.plans.catalog import QUERIES as CATALOG
from logloom.plans.models import FEATURE_FRACTIONS

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value + 0.0 if isinstance(value, float) else value


def table(names, data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    found = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(found, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", list(entry_module.oracle_sql()))
def test_query(spark, duck, name):
    frame = entry_module.queries()[name](spark, DATA)
    result = duck.execute(entry_module.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert table(frame.columns, frame.collect()) == table(columns, result.fetchall())


@pytest.fixture(scope="module")
def students(spark):
    """All students, and the hidden ones."""
    everyone = {r[0] for r in spark.read.parquet(f"{DATA}/events.parquet").select("user_id").distinct().collect()}
    return everyone, {s for s in everyone if s % 4 == 0}


@pytest.mark.parametrize("name", ["rf_predict", "boosted_lr"])
def test_predictions(spark, students, name):
    found = CATALOG[name](spark, DATA).collect()
    assert {r["student_id"] for r in found} == students[1] and len(found) == len(students[1])
    assert all(0 <= r["probability_true"] <= 1 for r in found)
    assert all(r["probability_true"] + r["probability_false"] == pytest.approx(1) for r in found)
    assert len({r["probability_true"] for r in found}) > 1


def test_forest_grid(spark):
    found = CATALOG["rf_grid"](spark, DATA).collect()
    assert {(r["trees"], r["feature_fraction"]) for r in found} == {(t, f) for t in (5, 15, 30) for f in FEATURE_FRACTIONS}
    assert all(r["adj_score"] == pytest.approx(r["adj_auc"] + r["adj_kappa"]) for r in found)
    assert all(0 <= r[c] <= 1 for r in found for c in ("adj_auc", "adj_kappa"))


def test_fold_metrics(spark):
    found = CATALOG["fold_metrics"](spark, DATA).collect()
    assert {r["fold"] for r in found} == {0, 1}
    assert all(r["loss"] > 0 and 0 <= r["accuracy"] <= 1 and 0 <= r["auc"] <= 1 and -1 <= r["kappa"] <= 1 for r in found)


def test_routine(spark, students):
    found = CATALOG["routine_submission"](spark, DATA).collect()
    assert {r["ord"] for r in found} == students[1] and len(found) == len(students[1])
    values = [float(r["value"].removesuffix(",")) for r in found]
    assert all(0 <= v <= 1 for v in values) and len(set(values)) > 1


def test_no_query_is_without_a_check():
    checked = {"rf_predict", "boosted_lr", "rf_grid", "fold_metrics", "routine_submission"}
    assert set(CATALOG) - set(entry_module.oracle_sql()) == checked


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
