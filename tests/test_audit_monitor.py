from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dqengine.operators import audit as A
from dqengine.operators import monitor as M
from dqengine.plans.workflows import completion

NOW = datetime(2024, 1, 31, 12)
AS_OF = "2024-01-31 12:00:00"
DATASET = "dataset_id long, dataset_name string, quality_score double, status string, processed_at timestamp_ntz"


def _ago(**kw):
    return NOW - timedelta(**kw)


@pytest.fixture(scope="module")
def datasets(spark):
    rows = [
        (1, "a", 69.9, "PROCESSING", _ago(minutes=5)),
        (2, "b", 70.0, "FAILED", _ago(minutes=30)),
        (3, "c", 0.0, "FAILED", _ago(minutes=29)),
        (4, "d", 10.0, "PROCESSING", _ago(minutes=11)),
        (5, "e", 50.0, "COMPLETED", _ago(hours=13)),
        (6, "f", 50.0, "PENDING_APPROVAL", _ago(days=2)),
        (7, "g", 20.0, "COMPLETED", NOW + timedelta(minutes=1)),
    ]
    return spark.createDataFrame(rows, DATASET)


def test_window_borders(datasets):
    assert M.attention_count(datasets, AS_OF).first()[0] == 3
    assert {r["dataset_id"] for r in M.quality_alerts(datasets, AS_OF).collect()} == {1, 4}
    assert {r["dataset_id"] for r in M.stalled_datasets(datasets, AS_OF).collect()} == {4}


def _feeds(spark):
    sources = spark.createDataFrame(
        [(1, "due", 300, True), (2, "fresh", 300, True), (3, "never", 60, True), (4, "manual", 0, True), (5, "off", 60, False)],
        "source_id long, source_name string, fetch_interval int, is_active boolean",
    )
    snapshots = spark.createDataFrame(
        [(1, 1, _ago(seconds=300)), (2, 2, _ago(seconds=299)), (3, 5, _ago(days=3)), (4, 1, NOW + timedelta(hours=1))],
        "snapshot_id long, source_id long, fetched_at timestamp_ntz",
    )
    return sources, snapshots


def test_due_feeds_and_next_times(spark):
    sources, snapshots = _feeds(spark)
    assert {r["source_id"] for r in M.due_feeds(sources, snapshots, AS_OF).collect()} == {1, 3}
    nexts = {r["source_id"]: (r["seconds_left"], r["next_in"]) for r in M.next_fetch_times(sources, snapshots, AS_OF).collect()}
    assert nexts == {1: (0, "due"), 2: (1, "1s")}


def test_metrics_and_tick(spark, datasets):
    sources, snapshots = _feeds(spark)
    actions = spark.createDataFrame(
        [(1, "API_AUTO_FETCH", _ago(minutes=60)), (2, "API_AUTO_FETCH", _ago(minutes=61)), (3, "API_AUTO_FETCH_FAILED", _ago(hours=24))],
        "action_id long, action_type string, action_at timestamp_ntz",
    )
    row = M.system_metrics(datasets, actions, AS_OF).first()
    assert (row["datasets_today"], row["active_jobs"], row["recent_actions"], row["quality_alerts"]) == (4, 3, 1, 3)
    assert row["avg_quality_today"] == 50.0
    feeds = M.feed_metrics(sources, snapshots, actions, AS_OF).first().asDict()
    assert feeds == {
        "total_sources": 5, "active_sources": 4, "snapshots_today": 2, "recent_fetches": 1, "failed_fetches": 1,
    }
    tick = M.tick_summary(sources, snapshots, datasets, AS_OF).first().asDict()
    assert tick == {"new_datasets": 3, "quality_alerts": 2, "stalled": 1, "api_fetches": 2}
    nothing = M.tick_summary(sources.where("false"), snapshots, datasets.where("false"), AS_OF)
    assert nothing.count() == 0
    empty = M.system_metrics(datasets.where("false"), actions, AS_OF).first()
    assert empty["avg_quality_today"] == 0.0


@pytest.mark.parametrize("seconds,text", [(59, "59s ago"), (60, "1m ago"), (3599, "59m ago"), (3600, "1h ago"), (90000, "25h ago")])
def test_ages(spark, seconds, text):
    assert spark.range(1).select(M.age_text(F.lit(seconds))).first()[0] == text


def test_units(spark):
    row = spark.range(1).select(*[M.interval_seconds(F.lit(2), F.lit(u)) for u in ("seconds", "minutes", "hours")]).first()
    assert tuple(row) == (2, 120, 7200)


def test_summary_counts_datasets_without_issues(spark, datasets):
    issues = spark.createDataFrame([(1,), (1,), (99,)], "dataset_id long")
    found = {r["dataset_id"]: r["issues_found"] for r in A.dataset_summary(datasets, issues).collect()}
    assert found[1] == 2 and found[2] == 0 and len(found) == 7
    first = A.dataset_summary(datasets, issues).first()
    assert first["dataset_id"] == 7
    totals = A.dashboard_totals(A.dataset_summary(datasets, issues)).first()
    assert (totals["total_datasets"], totals["total_issues"], totals["processing"]) == (7, 2, 2)


def test_removal_cascades(spark):
    sources, snapshots = _feeds(spark)
    kept, left = A.remove_sources(sources, snapshots, spark.createDataFrame([(1,), (1,)], "source_id long"))
    assert kept.count() == 4 and {r["source_id"] for r in left.collect()} == {2, 5}


def test_current_state_and_labels(spark):
    events = spark.createDataFrame([("k", 1, "EXECUTING"), ("k", 2, "COMPLETED"), ("j", 1, "ODD")], "k string, t int, s string")
    state = {r["k"]: r["s"] for r in A.current_state(events, "k", ["t"], ["s"]).collect()}
    assert state == {"k": "COMPLETED", "j": "ODD"}
    labels = {r["s"]: r["l"] for r in events.select("s", A.status_label(F.col("s")).alias("l")).collect()}
    assert labels == {"EXECUTING": "yellow", "COMPLETED": "green", "ODD": "grey"}


@pytest.mark.parametrize("length,expected", [(100, 100), (101, 103)])
def test_shortening(spark, length, expected):
    assert len(spark.range(1).select(A.shortened(F.lit("x" * length))).first()[0]) == expected


def test_report_over_all_or_the_latest_actions(spark):
    issues = spark.createDataFrame([(1, "N", "HIGH"), (1, "N", "LOW")], "dataset_id long, issue_type string, severity string")
    actions = spark.createDataFrame(
        [(i, 1, "A", "COMPLETED" if i < 5 else "FAILED", i) for i in range(8)],
        "action_id long, dataset_id long, agent_name string, execution_status string, action_at int",
    )
    got = {(r["section"], r["item"]): r["n"] for r in A.processing_report(issues, actions, latest=4).collect()}
    assert got == {
        ("issues_by_type", "N"): 2, ("issues_by_severity", "HIGH"): 1, ("issues_by_severity", "LOW"): 1,
        ("total_issues", None): 2, ("actions_by_agent", "A"): 4, ("actions_by_status", "FAILED"): 3,
        ("actions_by_status", "COMPLETED"): 1, ("total_actions", None): 4,
    }
    whole = {(r["section"], r["item"]): r["n"] for r in A.processing_report(issues, actions).collect()}
    assert whole["total_actions", None] == 8 and whole["actions_by_status", "COMPLETED"] == 5
    assert A.action_metrics(actions).first()["total_actions"] == 8


def test_completion_rule(spark):
    pending = spark.createDataFrame([(1,), (1,), (2,)], "dataset_id long")
    executed = spark.createDataFrame([(1,), (2,)], "dataset_id long")
    scores = spark.createDataFrame(
        [(1, 50.0, 90.0), (2, 50.0, 95.0), (3, 70.0, None)], "dataset_id long, initial_score double, final_score double"
    )
    got = {r["dataset_id"]: (r["status"], r["display_score"]) for r in completion(pending, executed, scores).collect()}
    assert got == {1: ("HEALING_IN_PROGRESS", 50.0), 2: ("COMPLETED", 95.0), 3: ("COMPLETED", 70.0)}
