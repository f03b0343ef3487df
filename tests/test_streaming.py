from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from dqengine.operators.learning import learning_patterns
from dqengine.streaming import jobs as J

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _minutes(n):
    return START + timedelta(minutes=n)


class Feed:
    """A folder that receives one file per call, streamed file by file."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema

    def land(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return J.landed_files(self.spark, self.path, files_per_batch=1)


def test_every_batch_is_scored_and_a_restart_goes_on(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "id int, v double")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        J.score_batches(feed.stream(), "feed", out, state, J.DRAIN).awaitTermination()

    feed.land([(i, float(i)) for i in range(10)])
    run()
    feed.land([(i, None) for i in range(6)] + [(i, 1.0) for i in range(6, 10)])
    run()
    scores = {r["batch_id"]: r["quality_score"] for r in spark.read.parquet(out + "/scores").collect()}
    assert scores == {0: 100.0, 1: 40.0}
    assert [r["batch_id"] for r in spark.read.parquet(out + "/alerts").collect()] == [1]
    issue = spark.read.parquet(out + "/issues").first()
    assert (issue["issue_type"], issue["affected_rows"], issue["batch_id"]) == ("NULL_VALUES", 6, 1)


def test_late_rows_are_dropped_from_windows(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "ts timestamp, v double")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        metrics = J.window_metrics(feed.stream(), "ts", "1 hour", delay="10 minutes")
        J.write_stream(metrics, out, state, J.DRAIN).awaitTermination()

    feed.land([(_minutes(5), 1.0), (_minutes(30), 2.0), (_minutes(90), 3.0)])
    run()
    feed.land([(_minutes(10), 9.0), (_minutes(100), 4.0), (_minutes(200), 5.0)])
    run()
    rows = {r["window_start"].hour: r["rows"] for r in spark.read.parquet(out).collect()}
    assert rows == {0: 2, 1: 2}


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "id int, ts timestamp")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    feed.land([(1, _minutes(1)), (2, _minutes(2)), (2, _minutes(2))])
    feed.land([(2, _minutes(3)), (3, _minutes(4))])
    J.write_stream(J.drop_repeated(feed.stream(), ["id"], "ts"), out, state, J.DRAIN).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_stalled_jobs_across_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "job string, ts timestamp, status string")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    feed.land([("ok", _minutes(0), "START"), ("edge", _minutes(3), "START"), ("slow", _minutes(2), "START")])
    feed.land([("ok", _minutes(5), "DONE"), ("edge", _minutes(13), "DONE"), ("slow", _minutes(13), "DONE")])
    feed.land([("later", _minutes(60), "START")])
    stalled = J.stalled_jobs(feed.stream(), F.col("status") == "START", "job", "ts")
    J.write_stream(stalled, out, state, J.DRAIN).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert [(r["job"], r["status"]) for r in rows] == [("slow", "START")]


def test_pattern_counts_equal_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "agent_name string, action_type string, context string, success_score double, logged_at timestamp")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for day in range(3):
        feed.land([("A", "x", f"c{i % 2}", float(i % 3 > 0), _minutes(day)) for i in range(7 + day)])
        J.count_patterns(feed.stream(), out, state, J.DRAIN).awaitTermination()
    batch = learning_patterns(spark.read.parquet(feed.path)).select(
        "agent_name", "pattern", "attempts", "successes", "success_rate", "confidence"
    )
    current = J.current_patterns(spark, out)
    assert sorted(map(tuple, current.collect())) == sorted(map(tuple, batch.collect()))


def test_feed_ingest_reads_new_files_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.json").write_text('{"hourly": {"t": [%d, %d]}, "id": %d}\n{"id": 1}\n' % (i, i + 1, i))
        J.ingest_feed(J.landed_payloads(spark, str(folder)), "id int, t int", out, state, J.DRAIN).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r["id"], r["t"]) for r in rows if r["t"] is not None) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3)]
    assert [r["id"] for r in rows if r["t"] is None] == [1, 1, 1]  # plain objects are rows too


def test_feed_ingest_keeps_every_shape(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    shapes = ['{"hourly": {"t": [1, 2]}}', '{"daily": {"t": [3]}}', '{"t": 4}', '[{"t": 5}, {"t": 6}]', "{broken"]
    (folder / "a.json").write_text("\n".join(shapes))
    payloads = J.landed_payloads(spark, str(folder))
    J.ingest_feed(payloads, "t int", out, str(tmp_path / "s1"), J.DRAIN).awaitTermination()
    assert sorted(r["t"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5, 6]
    J.keep_rejected(payloads, f"{out}-rejected", str(tmp_path / "s2"), J.DRAIN).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{out}-rejected").collect()] == [("{broken", "not JSON")]


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_windows_equal_batch(spark, tmp_path, slide):
    feed = Feed(spark, tmp_path / "in", "ts timestamp, v double")
    feed.land([(_minutes(7 * i), float(i)) for i in range(100)])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    J.write_stream(
        J.window_metrics(feed.stream(), "ts", "1 hour", slide, measures=[F.sum("v").alias("v")]), out, state, J.DRAIN
    ).awaitTermination()
    frame = F.window("ts", "1 hour", slide) if slide else F.window("ts", "1 hour")
    mark = _minutes(7 * 99 - 10)
    batch = (
        spark.read.parquet(feed.path).groupBy(frame.alias("w")).agg(F.count("*").alias("rows"), F.sum("v").alias("v"))
        .where(F.col("w.end") <= F.lit(mark)).select("w.start", "rows", "v")
    )
    got = spark.read.parquet(out).select("window_start", "rows", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
