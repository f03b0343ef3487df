"""Queries over the dataset registry, the issue log and the action log.

The logs are append-only. A status change is a new row, and the current state of a key is
its latest row, so nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Display labels of execution states.
STATUS_LABELS = {
    "COMPLETED": "green",
    "EXECUTING": "yellow",
    "PENDING_APPROVAL": "yellow",
    "FAILED": "red",
    "REJECTED": "red",
    "AUTO_APPROVED": "green",
}
PENDING_STATES = ("PENDING_APPROVAL", "EXECUTING")
DETAIL_LENGTH = 100
RECENT = 50


def dataset_summary(datasets: DataFrame, issues: DataFrame) -> DataFrame:
    """Datasets with their issue count, newest first; issues are counted before the join."""
    counted = issues.groupBy("dataset_id").agg(F.count("*").alias("issues_found"))
    return (
        datasets.join(counted, "dataset_id", "left")
        .fillna(0, ["issues_found"])
        .orderBy(F.desc("processed_at"), "dataset_id")
    )


def recent_actions(actions: DataFrame, limit: int = RECENT) -> DataFrame:
    """The latest actions overall."""
    return actions.orderBy(F.desc("action_at"), F.desc("action_id")).limit(limit)


def latest_per_key(
    df: DataFrame, key: str, order_by: Sequence[str], limit: int, rank: str = "recency"
) -> DataFrame:
    """The ``limit`` latest rows of every key, ranked.

    Spark cuts each task's rows to ``limit`` per key before the shuffle, so a hot key
    sends at most ``limit`` rows per task to its window.
    """
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order_by])
    return df.withColumn(rank, F.row_number().over(newest)).where(F.col(rank) <= limit)


def recent_actions_by_dataset(actions: DataFrame, limit: int = RECENT) -> DataFrame:
    """The latest actions of every dataset."""
    return latest_per_key(actions, "dataset_id", ["action_at", "action_id"], limit)


def stored_sizes(datasets: DataFrame, content: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Datasets with the JSON length of their stored content, newest first."""
    text = F.to_json(F.struct(*columns))
    sizes = content.groupBy("dataset_id").agg(F.sum(F.length(text)).alias("stored_size"))
    return (
        datasets.join(sizes, "dataset_id", "left")
        .fillna(0, ["stored_size"])
        .orderBy(F.desc("processed_at"), "dataset_id")
    )


def dataset_info(datasets: DataFrame, content: DataFrame) -> DataFrame:
    """Registry entry of every dataset with its record count; filter by id for one."""
    rows = content.groupBy("dataset_id").agg(F.count("*").alias("records"))
    return datasets.join(rows, "dataset_id", "left").fillna(0, ["records"])


def issues_by_dataset(issues: DataFrame) -> DataFrame:
    """All issues, newest first within each dataset; a range-partitioned sort."""
    return issues.orderBy("dataset_id", F.desc("detected_at"))


def processing_report(issues: DataFrame, actions: DataFrame, latest: int | None = None) -> DataFrame:
    """Counts per dataset as ``(dataset_id, section, item, n)``.

    Issues by type and by severity, actions by agent and by status, and both totals (item
    NULL); each log is read once with grouping sets. ``latest`` counts only that many of
    each dataset's newest actions.
    """

    def sections(df: DataFrame, first: str, second: str, names: tuple[str, str, str]) -> DataFrame:
        level = F.grouping_id()
        return (
            df.groupingSets(
                [["dataset_id", first], ["dataset_id", second], ["dataset_id"]],
                "dataset_id",
                first,
                second,
            )
            .agg(F.count("*").alias("n"), level.alias("__level"))
            .select(
                "dataset_id",
                F.when(F.col("__level") == 1, names[0])
                .when(F.col("__level") == 2, names[1])
                .otherwise(names[2])
                .alias("section"),
                F.coalesce(first, second).alias("item"),
                "n",
            )
        )

    found = sections(
        issues, "issue_type", "severity", ("issues_by_type", "issues_by_severity", "total_issues")
    )
    done = sections(
        actions if latest is None else recent_actions_by_dataset(actions, latest),
        "agent_name",
        "execution_status",
        ("actions_by_agent", "actions_by_status", "total_actions"),
    )
    return found.unionByName(done)


def current_state(events: DataFrame, key: str, order_by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Latest value of the fields per key from append-only rows."""
    order = F.struct(*order_by)
    latest = F.max_by(F.struct(*fields), order)
    return events.groupBy(key).agg(latest.alias("__state")).select(key, "__state.*")


def append_rows(rows: DataFrame, path: str) -> None:
    """Append log rows in one write job."""
    rows.write.mode("append").parquet(path)


def issue_log_rows(issues: DataFrame, dataset_id: str) -> DataFrame:
    """Issue-log rows of one profiled table."""
    return issues.select(
        F.lit(dataset_id).alias("dataset_id"),
        "issue_type",
        F.concat(
            F.coalesce("column_name", F.lit("Multiple columns")),
            F.lit(": "),
            F.col("percentage").cast("string"),
            F.lit("% affected"),
        ).alias("issue_description"),
        "affected_rows",
        "severity",
    )


def register_sources(sources: DataFrame, path: str) -> None:
    """Append feeds to the registry below ``path``; one without an interval is fetched by hand only."""
    append_rows(sources.fillna(0, ["fetch_interval"]).fillna(True, ["is_active"]), path)


def list_sources(sources: DataFrame) -> DataFrame:
    """Registered feeds, newest first; a range-partitioned sort."""
    return sources.orderBy(F.desc("source_id"))


def remove_sources(
    sources: DataFrame, snapshots: DataFrame, removals: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Sources and snapshots that stay once ``removals(source_id)`` and all they own are gone."""
    gone = removals.select("source_id").distinct()
    return (
        sources.join(gone, "source_id", "left_anti"),
        snapshots.join(gone, "source_id", "left_anti"),
    )


def dashboard_totals(summary: DataFrame) -> DataFrame:
    """One row over the dataset summary."""
    return summary.agg(
        F.count("*").alias("total_datasets"),
        F.avg("quality_score").alias("avg_quality_score"),
        F.coalesce(F.sum("issues_found"), F.lit(0)).alias("total_issues"),
        F.count_if(F.col("status") == "PROCESSING").alias("processing"),
    )


def score_trend(datasets: DataFrame) -> DataFrame:
    """Scores in time order."""
    return datasets.select("processed_at", "dataset_id", "quality_score").orderBy(
        "processed_at", "dataset_id"
    )


def hourly_score_trend(datasets: DataFrame, hours: int = 6) -> DataFrame:
    """Mean score per hour with a moving mean over the last hours that have data.

    The window runs over hours, not over datasets, so its one partition stays small.
    """
    hourly = datasets.groupBy(F.date_trunc("hour", F.col("processed_at")).alias("hour")).agg(
        F.count("*").alias("datasets"), F.sum("quality_score").alias("__sum")
    )
    last = Window.orderBy("hour").rowsBetween(-(hours - 1), 0)
    return hourly.select(
        F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"),
        "datasets",
        (F.col("__sum") / F.col("datasets")).alias("avg_quality_score"),
        (F.sum("__sum").over(last) / F.sum("datasets").over(last)).alias("moving_avg_score"),
    )


def action_metrics(actions: DataFrame, latest: int | None = None) -> DataFrame:
    """One row over all actions, or over the ``latest`` so many."""
    counted = actions if latest is None else recent_actions(actions, latest)
    return counted.agg(
        F.count("*").alias("total_actions"),
        F.count_if(F.col("execution_status") == "COMPLETED").alias("completed"),
        F.count_if(F.col("execution_status").isin(*PENDING_STATES)).alias("pending"),
        F.countDistinct("agent_name").alias("active_agents"),
    )


def status_label(status: Column) -> Column:
    label = F.lit("grey")
    for state, colour in STATUS_LABELS.items():
        label = F.when(status == state, colour).otherwise(label)
    return label


def shortened(text: Column, length: int = DETAIL_LENGTH) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(
        text
    )
