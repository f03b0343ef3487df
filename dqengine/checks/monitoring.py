"""Registered time-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqengine.checks.registry import check
from dqengine.operators import monitor as M
from dqengine.sources.views import DATASET_CLOCK, EVENT_CLOCK, table

FEEDS = ("feed_sources", "feed_snapshots")
E_NOW = f"timestamp '{EVENT_CLOCK}'"
D_NOW = f"timestamp '{DATASET_CLOCK}'"
LAST = (
    f"l as (select s.*, last_fetch from feed_sources s left join (select source_id, max(fetched_at) as last_fetch "
    f"from feed_snapshots where fetched_at <= {E_NOW} group by source_id) using (source_id))"
)
DUE = (
    f"is_active and fetch_interval <> 0 and (last_fetch is null or "
    f"last_fetch + fetch_interval * interval '1' second <= {E_NOW})"
)


def _feeds(spark, d):
    return table(spark, d, "feed_sources"), table(spark, d, "feed_snapshots")


@check(
    "w01_due_feeds",
    FEEDS,
    f"with {LAST} select source_id, source_name, fetch_interval, is_active, last_fetch from l where {DUE}",
)
def w01(spark, d):
    return M.due_feeds(*_feeds(spark, d), EVENT_CLOCK)


@check(
    "w02_datasets_needing_attention",
    ("datasets",),
    "select count(*) as needing_attention from datasets where status in ('PROCESSING', 'FAILED') "
    f"and processed_at > {D_NOW} - interval '30' minute and processed_at <= {D_NOW}",
)
def w02(spark, d):
    return M.attention_count(table(spark, d, "datasets"), DATASET_CLOCK)


@check(
    "w03_quality_alerts",
    ("datasets",),
    "select dataset_id, dataset_name, quality_score, processed_at from datasets where quality_score < 70 and quality_score > 0 "
    f"and processed_at > {D_NOW} - interval '2' hour and processed_at <= {D_NOW}",
)
def w03(spark, d):
    return M.quality_alerts(table(spark, d, "datasets"), DATASET_CLOCK)


@check(
    "w04_stalled_datasets",
    ("datasets",),
    "select dataset_id, dataset_name, processed_at from datasets where status = 'PROCESSING' "
    f"and processed_at < {D_NOW} - interval '10' minute",
)
def w04(spark, d):
    return M.stalled_datasets(table(spark, d, "datasets"), DATASET_CLOCK)


@check(
    "w05_system_metrics",
    ("datasets", "actions_log"),
    f"select count(*) filter (where processed_at >= date_trunc('day', {E_NOW}) and processed_at <= {E_NOW}) as datasets_today, "
    "count(*) filter (where status in ('PROCESSING', 'PENDING_APPROVAL')) as active_jobs, "
    f"round(coalesce(avg(quality_score) filter (where processed_at >= date_trunc('day', {E_NOW}) and processed_at <= {E_NOW} "
    "and quality_score > 0), 0), 1) as avg_quality_today, "
    f"count(*) filter (where processed_at >= {E_NOW} - interval '1' day and processed_at <= {E_NOW} and quality_score < 70 and quality_score > 0) as quality_alerts, "
    f"(select count(*) from actions_log where action_at >= {E_NOW} - interval '1' hour and action_at <= {E_NOW}) as recent_actions "
    "from datasets",
)
def w05(spark, d):
    return M.system_metrics(table(spark, d, "datasets"), table(spark, d, "actions_log"), EVENT_CLOCK)


@check(
    "w06_feed_metrics",
    (*FEEDS, "actions_log"),
    "select count(*) as total_sources, count(*) filter (where is_active) as active_sources, "
    f"(select count(*) from feed_snapshots where fetched_at >= date_trunc('day', {E_NOW}) and fetched_at <= {E_NOW}) as snapshots_today, "
    f"(select count(*) from actions_log where action_type = 'API_AUTO_FETCH' and action_at >= {E_NOW} - interval '1' hour and action_at <= {E_NOW}) as recent_fetches, "
    f"(select count(*) from actions_log where action_type = 'API_AUTO_FETCH_FAILED' and action_at >= {E_NOW} - interval '1' day and action_at <= {E_NOW}) as failed_fetches "
    "from feed_sources",
)
def w06(spark, d):
    return M.feed_metrics(*_feeds(spark, d), table(spark, d, "actions_log"), EVENT_CLOCK)


@check(
    "w07_tick_summary",
    (*FEEDS, "datasets"),
    f"with {LAST}, c as (select (select count(*) from l where {DUE}) as api_fetches, "
    f"count(*) filter (where status in ('PROCESSING', 'FAILED') and processed_at > {E_NOW} - interval '30' minute and processed_at <= {E_NOW}) as new_datasets, "
    f"count(*) filter (where quality_score < 70 and quality_score > 0 and processed_at > {E_NOW} - interval '2' hour and processed_at <= {E_NOW}) as quality_alerts, "
    f"count(*) filter (where status = 'PROCESSING' and processed_at < {E_NOW} - interval '10' minute) as stalled from datasets) "
    "select * from c where api_fetches > 0 or new_datasets > 0 or quality_alerts > 0 or stalled > 0",
)
def w07(spark, d):
    return M.tick_summary(*_feeds(spark, d), table(spark, d, "datasets"), EVENT_CLOCK)


@check(
    "w08_activity_feed",
    ("actions_log",),
    f"with r as (select *, cast(floor(epoch({E_NOW}) - epoch(action_at)) as bigint) as s from actions_log where action_at <= {E_NOW} "
    "order by action_at desc, action_id desc limit 50) select action_id, agent_name, action_type, action_at, "
    "case when s < 60 then concat(s, 's ago') when s < 3600 then concat(s // 60, 'm ago') else concat(s // 3600, 'h ago') end as age from r",
)
def w08(spark, d):
    return M.activity_feed(table(spark, d, "actions_log"), EVENT_CLOCK)


@check(
    "w08_activity_ages",
    ("actions_log",),
    f"with r as (select *, cast(floor(epoch({E_NOW}) - epoch(action_at)) as bigint) as s from actions_log) "
    "select action_id, case when s < 60 then concat(s, 's ago') when s < 3600 then concat(s // 60, 'm ago') "
    "else concat(s // 3600, 'h ago') end as age from r where s >= 0",
)
def w08_ages(spark, d):
    age = M.seconds_between(F.col("action_at"), F.lit(EVENT_CLOCK).cast("timestamp_ntz"))
    rows = table(spark, d, "actions_log").withColumn("s", age).where("s >= 0")
    return rows.select("action_id", M.age_text(F.col("s")).alias("age"))


@check(
    "w09_next_fetch_times",
    FEEDS,
    f"with {LAST}, n as (select *, last_fetch + fetch_interval * interval '1' second as next_fetch from l "
    "where is_active and fetch_interval > 0 and last_fetch is not null), "
    f"t as (select *, cast(floor(epoch(next_fetch) - epoch({E_NOW})) as bigint) as seconds_left from n) "
    "select source_id, source_name, last_fetch, next_fetch, seconds_left, case when seconds_left <= 0 then 'due' "
    "when seconds_left < 60 then concat(seconds_left, 's') when seconds_left < 3600 then concat(seconds_left // 60, 'm') "
    "else strftime(next_fetch, '%H:%M:%S') end as next_in from t",
)
def w09(spark, d):
    return M.next_fetch_times(*_feeds(spark, d), EVENT_CLOCK)


UNIT = "case source_id % 3 when 0 then 'seconds' when 1 then 'minutes' else 'hours' end"


@check(
    "w09_interval_units",
    ("feed_sources",),
    f"select source_id, {UNIT} as unit, cast(fetch_interval * case source_id % 3 when 0 then 1 when 1 then 60 else 3600 end as integer) "
    "as interval_seconds from feed_sources",
)
def w09_units(spark, d):
    sources = table(spark, d, "feed_sources").withColumn("unit", F.expr(UNIT))
    return sources.select(
        "source_id",
        "unit",
        M.interval_seconds(F.col("fetch_interval"), F.col("unit")).alias("interval_seconds"),
    )


@check(
    "w10_fetch_log_rows",
    ("feed_sources",),
    "with r as (select user_id as source_id, cast(floor(value) as bigint) as records_count, "
    "case when event_type = 'error' then 'timeout' end as error, ts as fetched_at from events), "
    "n as (select r.*, coalesce(source_name, concat('source ', source_id)) as name from r left join feed_sources using (source_id)) "
    "select cast(null as varchar) as dataset_id, 'RealTimeMonitor' as agent_name, "
    "case when error is null then 'API_AUTO_FETCH' else 'API_AUTO_FETCH_FAILED' end as action_type, "
    "case when error is null then concat('Auto-fetched ', records_count, ' records from ', name) "
    "else concat('Failed to auto-fetch from ', name, ': ', error) end as action_details, "
    "case when error is null then 'COMPLETED' else 'FAILED' end as execution_status, fetched_at as action_at from n",
)
def w10(spark, d):
    results = table(spark, d, "events").select(
        F.col("user_id").alias("source_id"),
        F.floor("value").alias("records_count"),
        F.when(F.col("event_type") == "error", "timeout").alias("error"),
        F.col("ts").alias("fetched_at"),
    )
    return M.fetch_log_rows(results, table(spark, d, "feed_sources"))
