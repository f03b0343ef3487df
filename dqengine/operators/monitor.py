"""Time-window checks and metrics. Every query takes the moment ``as_of`` as its "now"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.schemas import RULES

ATTENTION_MINUTES = 30
ALERT_HOURS = 2
STALLED_MINUTES = 10
UNIT_SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600}


def _moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _before(as_of: str, amount: int, unit: str) -> Column:
    return _moment(as_of) - F.expr(f"interval {amount} {unit}")


def _after(column: str, limit: Column, as_of: str, inclusive: bool = False) -> Column:
    start = F.col(column) >= limit if inclusive else F.col(column) > limit
    return start & (F.col(column) <= _moment(as_of))


def _today(column: str, as_of: str) -> Column:
    return _after(column, F.date_trunc("day", _moment(as_of)).cast("timestamp_ntz"), as_of, True)


def _low_score() -> Column:
    return (F.col("quality_score") < RULES.alert_score) & (F.col("quality_score") > 0)


def last_fetches(snapshots: DataFrame, as_of: str) -> DataFrame:
    """Time of the latest snapshot per source up to ``as_of``."""
    return (
        snapshots.where(F.col("fetched_at") <= _moment(as_of))
        .groupBy("source_id")
        .agg(F.max("fetched_at").alias("last_fetch"))
    )


def sources_with_last_fetch(sources: DataFrame, snapshots: DataFrame, as_of: str) -> DataFrame:
    return sources.join(last_fetches(snapshots, as_of), "source_id", "left")


def _next_fetch() -> Column:
    return F.col("last_fetch") + F.make_dt_interval(secs=F.col("fetch_interval"))


def due_feeds(sources: DataFrame, snapshots: DataFrame, as_of: str) -> DataFrame:
    """Active scheduled feeds that were never fetched or whose interval has passed."""
    overdue = F.col("last_fetch").isNull() | (_next_fetch() <= _moment(as_of))
    return sources_with_last_fetch(sources, snapshots, as_of).where(
        F.col("is_active") & (F.col("fetch_interval") != 0) & overdue
    )


def attention_count(datasets: DataFrame, as_of: str) -> DataFrame:
    """One row: datasets processing or failed in the last half hour."""
    recent = _after("processed_at", _before(as_of, ATTENTION_MINUTES, "minutes"), as_of)
    return datasets.agg(
        F.count_if(F.col("status").isin("PROCESSING", "FAILED") & recent).alias("needing_attention")
    )


def quality_alerts(datasets: DataFrame, as_of: str) -> DataFrame:
    """Datasets of the last two hours that scored low."""
    recent = _after("processed_at", _before(as_of, ALERT_HOURS, "hours"), as_of)
    return datasets.where(recent & _low_score()).select(
        "dataset_id", "dataset_name", "quality_score", "processed_at"
    )


def stalled_datasets(datasets: DataFrame, as_of: str) -> DataFrame:
    """Datasets that have been processing for more than ten minutes."""
    old = F.col("processed_at") < _before(as_of, STALLED_MINUTES, "minutes")
    return datasets.where((F.col("status") == "PROCESSING") & old).select(
        "dataset_id", "dataset_name", "processed_at"
    )


def system_metrics(datasets: DataFrame, actions: DataFrame, as_of: str) -> DataFrame:
    """One row of metrics; each table is scanned once."""
    today = _today("processed_at", as_of)
    day = _after("processed_at", _before(as_of, 1, "day"), as_of, True)
    hour = _after("action_at", _before(as_of, 1, "hour"), as_of, True)
    scored = F.when(today & (F.col("quality_score") > 0), F.col("quality_score"))
    recent = actions.agg(F.count_if(hour).alias("n")).scalar()
    return datasets.agg(
        F.count_if(today).alias("datasets_today"),
        F.count_if(F.col("status").isin("PROCESSING", "PENDING_APPROVAL")).alias("active_jobs"),
        F.round(F.coalesce(F.avg(scored), F.lit(0.0)), 1).alias("avg_quality_today"),
        F.count_if(day & _low_score()).alias("quality_alerts"),
    ).withColumn("recent_actions", recent)


def feed_metrics(
    sources: DataFrame, snapshots: DataFrame, actions: DataFrame, as_of: str
) -> DataFrame:
    """One row of feed metrics; each table is scanned once."""
    hour = _after("action_at", _before(as_of, 1, "hour"), as_of, True)
    day = _after("action_at", _before(as_of, 1, "day"), as_of, True)
    fetched = F.col("action_type") == "API_AUTO_FETCH"
    failed = F.col("action_type") == "API_AUTO_FETCH_FAILED"
    log = actions.agg(
        F.struct(F.count_if(fetched & hour).alias("ok"), F.count_if(failed & day).alias("bad")).alias("s")
    ).scalar()
    stored = snapshots.agg(F.count_if(_today("fetched_at", as_of)).alias("n")).scalar()
    return sources.agg(
        F.count("*").alias("total_sources"), F.count_if(F.col("is_active")).alias("active_sources")
    ).withColumns({"snapshots_today": stored, "__log": log}).select(
        "total_sources",
        "active_sources",
        "snapshots_today",
        F.col("__log.ok").alias("recent_fetches"),
        F.col("__log.bad").alias("failed_fetches"),
    )


def tick_summary(
    sources: DataFrame, snapshots: DataFrame, datasets: DataFrame, as_of: str
) -> DataFrame:
    """One row with the four check counts, or none when there is nothing to report."""
    recent = _after("processed_at", _before(as_of, ATTENTION_MINUTES, "minutes"), as_of)
    alert = _after("processed_at", _before(as_of, ALERT_HOURS, "hours"), as_of) & _low_score()
    old = F.col("processed_at") < _before(as_of, STALLED_MINUTES, "minutes")
    due = due_feeds(sources, snapshots, as_of).agg(F.count("*").alias("n")).scalar()
    counts = datasets.agg(
        F.count_if(F.col("status").isin("PROCESSING", "FAILED") & recent).alias("new_datasets"),
        F.count_if(alert).alias("quality_alerts"),
        F.count_if((F.col("status") == "PROCESSING") & old).alias("stalled"),
    ).withColumn("api_fetches", due)
    return counts.where(
        (F.col("api_fetches") > 0)
        | (F.col("new_datasets") > 0)
        | (F.col("quality_alerts") > 0)
        | (F.col("stalled") > 0)
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / F.lit(1_000_000)).cast("long")


def age_text(seconds: Column) -> Column:
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    return (
        F.when(seconds < 60, F.format_string("%ds ago", seconds))
        .when(seconds < 3600, F.format_string("%dm ago", minutes))
        .otherwise(F.format_string("%dh ago", hours))
    )


def activity_feed(actions: DataFrame, as_of: str, limit: int = 50) -> DataFrame:
    """The latest actions with their age."""
    age = seconds_between(F.col("action_at"), _moment(as_of))
    return (
        actions.where(F.col("action_at") <= _moment(as_of))
        .orderBy(F.desc("action_at"), F.desc("action_id"))
        .limit(limit)
        .select("action_id", "agent_name", "action_type", "action_at", age_text(age).alias("age"))
    )


def next_fetch_times(sources: DataFrame, snapshots: DataFrame, as_of: str) -> DataFrame:
    """Next fetch and seconds left of every active scheduled feed fetched before."""
    left = seconds_between(_moment(as_of), F.col("next_fetch"))
    label = (
        F.when(F.col("seconds_left") <= 0, "due")
        .when(F.col("seconds_left") < 60, F.format_string("%ds", "seconds_left"))
        .when(F.col("seconds_left") < 3600, F.format_string("%dm", F.floor(F.col("seconds_left") / 60)))
        .otherwise(F.date_format("next_fetch", "HH:mm:ss"))
    )
    return (
        sources_with_last_fetch(sources, snapshots, as_of)
        .where(F.col("is_active") & (F.col("fetch_interval") > 0) & F.col("last_fetch").isNotNull())
        .withColumn("next_fetch", _next_fetch())
        .withColumn("seconds_left", left)
        .withColumn("next_in", label)
        .select("source_id", "source_name", "last_fetch", "next_fetch", "seconds_left", "next_in")
    )


def interval_seconds(amount: Column, unit: Column) -> Column:
    seconds = F.lit(1)
    for name, factor in UNIT_SECONDS.items():
        seconds = F.when(unit == name, factor).otherwise(seconds)
    return (amount * seconds).cast("int")


def fetch_log_rows(results: DataFrame, sources: DataFrame) -> DataFrame:
    """Action-log rows for fetch results ``(source_id, records_count, error, fetched_at)``."""
    name = F.coalesce("source_name", F.concat(F.lit("source "), F.col("source_id").cast("string")))
    failed = F.col("error").isNotNull()
    ok = F.concat(F.lit("Auto-fetched "), F.col("records_count").cast("string"), F.lit(" records from "), name)
    bad = F.concat(F.lit("Failed to auto-fetch from "), name, F.lit(": "), F.col("error"))
    return results.join(sources.select("source_id", "source_name"), "source_id", "left").select(
        F.lit(None).cast("string").alias("dataset_id"),
        F.lit("RealTimeMonitor").alias("agent_name"),
        F.when(failed, "API_AUTO_FETCH_FAILED").otherwise("API_AUTO_FETCH").alias("action_type"),
        F.when(failed, bad).otherwise(ok).alias("action_details"),
        F.when(failed, "FAILED").otherwise("COMPLETED").alias("execution_status"),
        F.col("fetched_at").alias("action_at"),
    )
