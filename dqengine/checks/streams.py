"""Registered streaming jobs, drained over files landed from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqengine.checks.history import PATTERNS
from dqengine.checks.registry import check
from dqengine.checks.sourcing import SIZES, _columnar
from dqengine.checks.sql import VIEWS, issues_cte, score
from dqengine.session import scratch_path
from dqengine.sources.views import table
from dqengine.streaming import jobs as J

LI, EV, DOC = VIEWS


def _land(df, label):
    """Write a derived table as arriving files; plain timestamps become zoned ones."""
    zoned = [
        F.col(name).cast("timestamp").alias(name) if kind == "timestamp_ntz" else F.col(name)
        for name, kind in df.dtypes
    ]
    path = scratch_path(df.sparkSession, label)
    df.select(*zoned).write.parquet(path)
    return J.landed_files(df.sparkSession, path)


def _drain(stream, label):
    """Run a streaming result to its end and read what it wrote."""
    spark = stream.sparkSession
    out = scratch_path(spark, f"{label}-out")
    J.write_stream(stream, out, scratch_path(spark, f"{label}-state"), J.DRAIN).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _plain(df):
    """Zoned timestamps back to plain ones."""
    return df.select(
        *[
            F.col(name).cast("timestamp_ntz").alias(name) if kind == "timestamp" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


@check("k01_rejected_payloads", (), "select cast(event_id as varchar) as payload, 'not JSON' as reason from events where false union all select concat('{', event_id), 'not JSON' from events where event_id % 5 = 0")
def k01_rejected(spark, d):
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "rejected")
    id_text = F.col("event_id").cast("string")
    table(spark, d, "events").select(
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), id_text)).otherwise(F.col("props")).alias("value")
    ).write.text(landing)
    J.keep_rejected(J.landed_payloads(spark, landing), out, scratch_path(spark, "rejected-state"), J.DRAIN).awaitTermination()
    return spark.read.parquet(out)


@check(
    "k01_feed_ingest",
    (),
    f"with {SIZES} select group_id, 'C' as unit, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as time, value "
    "from events join g on event_id // 24 = group_id",
)
def k01(spark, d):
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "feed-out")
    _columnar(spark, d).select("payload").write.text(landing)
    schema = "group_id bigint, unit string, event_id bigint, time string, value double"
    J.ingest_feed(
        J.landed_payloads(spark, landing), schema, out, scratch_path(spark, "feed-state"), J.DRAIN
    ).awaitTermination()
    return spark.read.parquet(out)


def _scored(spark, d, view):
    out = scratch_path(spark, "scores")
    stream = _land(table(spark, d, view), view)
    J.score_batches(stream, view, out, scratch_path(spark, "scores-state"), J.DRAIN).awaitTermination()
    return out


@check(
    "k02_scored_batches",
    (LI,),
    f"with {issues_cte(LI)} select '{LI}' as dataset_name, max(total_rows) as total_records, count(*) as issue_count, "
    f"round({score()}, 4) as quality_score from issues",
)
def k02(spark, d):
    scores = spark.read.parquet(_scored(spark, d, LI) + "/scores")
    return scores.select(
        "dataset_name", "total_records", "issue_count", F.round("quality_score", 4).alias("quality_score")
    )


@check(
    "k02_batch_issues",
    (EV,),
    f"with {issues_cte(EV)} select issue_type, column_name, affected_rows, percentage, severity from issues",
)
def k02_issues(spark, d):
    return spark.read.parquet(_scored(spark, d, EV) + "/issues").select(
        "issue_type", "column_name", "affected_rows", "percentage", "severity"
    )


def _windows(step: str, length: str, extra: str) -> str:
    return (
        f"w as (select {step} as window_start, event_type, value from {EV}{extra} where ts is not null), "
        f"m as (select max(ts) - interval '10' minute as mark from {EV}) "
        f"select window_start, window_start + interval {length} as window_end, count(*) as rows, "
        "count(*) - count(value) as missing_values, count(*) filter (where event_type = 'error') as errors "
        f"from w, m group by window_start, mark having window_start + interval {length} <= mark"
    )


def _measures():
    return (
        (F.count("*") - F.count("value")).alias("missing_values"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    )


@check(
    "k03_tumbling_metrics",
    (EV,),
    "with " + _windows("date_trunc('hour', ts)", "'1' hour", ""),
)
def k03(spark, d):
    stream = _land(table(spark, d, EV), "events")
    return _plain(_drain(J.window_metrics(stream, "ts", measures=_measures()), "tumbling"))


@check(
    "k03_sliding_metrics",
    (EV,),
    "with "
    + _windows(
        "time_bucket(interval '30' minute, ts) - slide * interval '30' minute",
        "'1' hour",
        ", (values (0), (1)) s(slide)",
    ),
)
def k03_sliding(spark, d):
    stream = _land(table(spark, d, EV), "events")
    metrics = J.window_metrics(stream, "ts", "1 hour", "30 minutes", measures=_measures())
    return _plain(_drain(metrics, "sliding"))


@check(
    "k04_stalled_jobs",
    ("actions_log",),
    "select action_id, dataset_id, action_at from actions_log a where execution_status = 'EXECUTING' "
    "and action_at + interval '10' minute < (select max(action_at) from actions_log) - interval '1' minute "
    "and not exists (select 1 from actions_log b where a.dataset_id = b.dataset_id and b.action_at > a.action_at "
    "and b.action_at <= a.action_at + interval '10' minute)",
)
def k04(spark, d):
    stream = _land(table(spark, d, "actions_log"), "actions")
    executing = F.col("execution_status") == "EXECUTING"
    stalled = J.stalled_jobs(stream, executing, "dataset_id", "action_at")
    return _plain(_drain(stalled.select("action_id", "dataset_id", "action_at"), "stalled"))


@check(
    "k05_repeated_events_dropped",
    (),
    "select event_id, ts, user_id, event_type, value, props from events",
)
def k05(spark, d):
    events = table(spark, d, "events")
    resent = events.unionByName(events.where("event_type in ('purchase', 'error')"))
    return _plain(_drain(J.drop_repeated(_land(resent, "resent"), ["event_id"], "ts"), "distinct"))


@check(
    "k06_pattern_counts",
    ("learning_log",),
    f"with {PATTERNS} select agent_name, pattern, attempts, successes, round(success_rate, 6) as success_rate, "
    "round(confidence, 6) as confidence from rated",
)
def k06(spark, d):
    out = scratch_path(spark, "patterns")
    stream = _land(table(spark, d, "learning_log"), "outcomes")
    J.count_patterns(stream, out, scratch_path(spark, "patterns-state"), J.DRAIN).awaitTermination()
    current = J.current_patterns(spark, out)
    return current.withColumns({c: F.round(c, 6) for c in ("success_rate", "confidence")})
