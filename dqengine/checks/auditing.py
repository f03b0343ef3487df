"""Registered queries over the metadata tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqengine.checks.healing import FULL_REPAIR
from dqengine.checks.planning import plan_ctes
from dqengine.checks.registry import check
from dqengine.checks.sql import VIEWS, issues_cte
from dqengine.operators import audit as A
from dqengine.operators.profile import find_issues
from dqengine.plans import workflows as W
from dqengine.session import scratch_path
from dqengine.sources.views import table

LI = VIEWS[0]
DATASETS = "dataset_id, dataset_name, quality_score, status, processed_at"
SUMMARY = (
    f"select {DATASETS}, coalesce(issues_found, 0) as issues_found from datasets left join "
    "(select dataset_id, count(*) as issues_found from quality_issues group by dataset_id) using (dataset_id)"
)
ACTIONS = "action_id, dataset_id, agent_name, action_type, execution_status, action_details, action_at"


def _summary(spark, d):
    return A.dataset_summary(table(spark, d, "datasets"), table(spark, d, "quality_issues"))


@check("m01_dataset_summary", ("datasets", "quality_issues"), SUMMARY)
def m01(spark, d):
    return _summary(spark, d)


@check(
    "m02_recent_actions",
    ("actions_log",),
    f"select {ACTIONS} from actions_log order by action_at desc, action_id desc limit 50",
)
def m02(spark, d):
    return A.recent_actions(table(spark, d, "actions_log"))


RECENT_SQL = (
    "select *, cast(row_number() over (partition by dataset_id order by action_at desc, action_id desc) as integer) "
    "as recency from actions_log qualify recency <= 50"
)


@check("m02_recent_actions_by_dataset", ("actions_log",), f"select {ACTIONS}, recency from ({RECENT_SQL})")
def m02_by_dataset(spark, d):
    return A.recent_actions_by_dataset(table(spark, d, "actions_log"))


@check(
    "m03_dataset_sizes",
    ("datasets", "quality_issues"),
    f"select {DATASETS}, coalesce(s, 0) as stored_size from datasets left join (select dataset_id, "
    "cast(sum(length(to_json({'issue_type': issue_type, 'severity': severity, 'affected_rows': affected_rows}))) as bigint) as s "
    "from quality_issues group by dataset_id) using (dataset_id)",
)
def m03(spark, d):
    return A.stored_sizes(
        table(spark, d, "datasets"),
        table(spark, d, "quality_issues"),
        ["issue_type", "severity", "affected_rows"],
    )


@check(
    "m04_dataset_info",
    ("datasets", "quality_issues"),
    f"select {DATASETS}, coalesce(records, 0) as records from datasets left join "
    "(select dataset_id, count(*) as records from quality_issues group by dataset_id) using (dataset_id)",
)
def m04(spark, d):
    return A.dataset_info(table(spark, d, "datasets"), table(spark, d, "quality_issues"))


@check(
    "m05_issues_by_dataset",
    ("quality_issues",),
    "select dataset_id, issue_type, severity, affected_rows, detected_at from quality_issues",
)
def m05(spark, d):
    return A.issues_by_dataset(table(spark, d, "quality_issues"))


def _sections(rel: str, first: str, second: str, names: tuple[str, str, str]) -> str:
    return (
        f"select dataset_id, '{names[0]}' as section, {first} as item, count(*) as n from {rel} group by all "
        f"union all select dataset_id, '{names[1]}', {second}, count(*) from {rel} group by all "
        f"union all select dataset_id, '{names[2]}', null, count(*) from {rel} group by all"
    )


@check(
    "m06_processing_report",
    ("quality_issues", "actions_log"),
    _sections("quality_issues", "issue_type", "severity", ("issues_by_type", "issues_by_severity", "total_issues"))
    + " union all "
    + _sections("actions_log", "agent_name", "execution_status", ("actions_by_agent", "actions_by_status", "total_actions")),
)
def m06(spark, d):
    return A.processing_report(table(spark, d, "quality_issues"), table(spark, d, "actions_log"))


@check(
    "m07_current_state",
    ("actions_log",),
    "select dataset_id, execution_status, action_type, action_at from actions_log qualify "
    "row_number() over (partition by dataset_id order by action_at desc, action_id desc) = 1",
)
def m07(spark, d):
    return A.current_state(
        table(spark, d, "actions_log"),
        "dataset_id",
        ["action_at", "action_id"],
        ["execution_status", "action_type", "action_at"],
    )


@check(
    "m08_appended_actions",
    ("actions_log",),
    f"select {ACTIONS}, 'batch' as batch from actions_log union all select {ACTIONS}, 'correction' from actions_log where execution_status = 'FAILED'",
)
def m08(spark, d):
    path = scratch_path(spark, "action-log")
    actions = table(spark, d, "actions_log")
    A.append_rows(actions.withColumn("batch", F.lit("batch")), path)
    failed = actions.where("execution_status = 'FAILED'")
    A.append_rows(failed.withColumn("batch", F.lit("correction")), path)
    return spark.read.parquet(path)


@check(
    "m09_issue_log_rows",
    (LI,),
    f"with {issues_cte(LI)} select 'lineitem' as dataset_id, issue_type, concat(coalesce(column_name, 'Multiple columns'), "
    "': ', percentage, '% affected') as issue_description, affected_rows, severity from issues",
)
def m09(spark, d):
    return A.issue_log_rows(find_issues(table(spark, d, LI)), "lineitem")


@check(
    "m10_feed_sources",
    ("feed_sources",),
    "select source_id, source_name, fetch_interval, is_active from feed_sources",
)
def m10(spark, d):
    path = scratch_path(spark, "sources")
    A.register_sources(table(spark, d, "feed_sources"), path)
    return A.list_sources(spark.read.parquet(path))


def _removal(spark, d):
    sources, snapshots = table(spark, d, "feed_sources"), table(spark, d, "feed_snapshots")
    return A.remove_sources(sources, snapshots, sources.where("not is_active").select("source_id"))


@check(
    "m11_sources_after_removal",
    ("feed_sources",),
    "select source_id, source_name, fetch_interval, is_active from feed_sources where is_active",
)
def m11_sources(spark, d):
    return _removal(spark, d)[0]


@check(
    "m11_snapshots_after_removal",
    ("feed_sources", "feed_snapshots"),
    "select snapshot_id, source_id, payload, snapshot_format, records_count, fetched_at from feed_snapshots "
    "where source_id not in (select source_id from feed_sources where not is_active)",
)
def m11_snapshots(spark, d):
    return _removal(spark, d)[1]


@check(
    "m12_dashboard_totals",
    ("datasets", "quality_issues"),
    f"with s as ({SUMMARY}) select count(*) as total_datasets, round(avg(quality_score), 6) as avg_quality_score, "
    "cast(sum(issues_found) as bigint) as total_issues, count(*) filter (where status = 'PROCESSING') as processing from s",
)
def m12(spark, d):
    return A.dashboard_totals(_summary(spark, d)).withColumn(
        "avg_quality_score", F.round("avg_quality_score", 6)
    )


@check("m13_score_trend", ("datasets",), "select processed_at, dataset_id, quality_score from datasets")
def m13(spark, d):
    return A.score_trend(table(spark, d, "datasets"))


@check(
    "m13_hourly_score_trend",
    ("datasets",),
    "with h as (select date_trunc('hour', processed_at) as hour, count(*) as datasets, sum(quality_score) as s "
    "from datasets group by 1) select strftime(hour, '%Y-%m-%d %H:%M') as hour, datasets, "
    "round(s / datasets, 6) as avg_quality_score, round(sum(s) over w / sum(datasets) over w, 6) as moving_avg_score "
    "from h window w as (order by hour rows between 5 preceding and current row)",
)
def m13_hourly(spark, d):
    trend = A.hourly_score_trend(table(spark, d, "datasets"))
    return trend.withColumns(
        {c: F.round(c, 6) for c in ("avg_quality_score", "moving_avg_score")}
    )


@check(
    "m14_action_metrics",
    ("actions_log",),
    "select count(*) as total_actions, count(*) filter (where execution_status = 'COMPLETED') as completed, "
    "count(*) filter (where execution_status in ('PENDING_APPROVAL', 'EXECUTING')) as pending, "
    "count(distinct agent_name) as active_agents from actions_log",
)
def m14(spark, d):
    return A.action_metrics(table(spark, d, "actions_log"))


@check(
    "m15_labelled_actions",
    ("actions_log",),
    "select action_id, case execution_status when 'COMPLETED' then 'green' when 'EXECUTING' then 'yellow' "
    "when 'PENDING_APPROVAL' then 'yellow' when 'FAILED' then 'red' when 'REJECTED' then 'red' when 'AUTO_APPROVED' then 'green' "
    "else 'grey' end as label, case when length(action_details) > 100 then concat(substr(action_details, 1, 100), '...') "
    "else action_details end as details from actions_log",
)
def m15(spark, d):
    return table(spark, d, "actions_log").select(
        "action_id",
        A.status_label(F.col("execution_status")).alias("label"),
        A.shortened(F.col("action_details")).alias("details"),
    )


@check(
    "m16_bulk_decision_log",
    (LI,),
    f"with {plan_ctes(LI)}, {FULL_REPAIR}, "
    "e as (select *, case when action_type = 'REMOVE_DUPLICATES' then (select count(*) from f) - (select count(*) from healed) "
    "else 0 end as records_affected from actions) "
    "select action_id, 'HumanOperator' as agent_name, concat('APPROVED_', action_type) as action_type, "
    "concat('Bulk approved ', action_type, ' - ', impact) as action_details, 'COMPLETED' as execution_status, "
    "'APPROVED' as human_approval from e union all "
    "select action_id, 'DataHealingAgent', concat('EXECUTED_', action_type), concat('Bulk executed ', recommended_method, "
    "' - Records affected: ', records_affected), 'COMPLETED', null from e",
)
def m16(spark, d):
    lines = table(spark, d, LI)
    done = W.repair_feed(lines, "lineitem")
    return W.decision_log(done.actions, done.healed.log)


@check(
    "m17_completion",
    ("datasets", "actions_log"),
    "with p as (select dataset_id, count(*) as pending_actions from actions_log where execution_status = 'PENDING_APPROVAL' group by 1), "
    "e as (select dataset_id, count(*) as executed_actions from actions_log where action_type like 'EXECUTED%' and execution_status = 'COMPLETED' group by 1), "
    "j as (select dataset_id, coalesce(pending_actions, 0) as pending_actions, coalesce(executed_actions, 0) as executed_actions, "
    "quality_score as initial_score, case when status <> 'FAILED' then least(100e0, quality_score + 10) end as final_score "
    "from datasets left join p using (dataset_id) left join e using (dataset_id)) "
    "select dataset_id, pending_actions, executed_actions, "
    "case when executed_actions >= pending_actions then 'COMPLETED' else 'HEALING_IN_PROGRESS' end as status, "
    "case when executed_actions >= pending_actions then coalesce(final_score, initial_score) else initial_score end as display_score from j",
)
def m17(spark, d):
    actions = table(spark, d, "actions_log")
    scores = table(spark, d, "datasets").select(
        "dataset_id",
        F.col("quality_score").alias("initial_score"),
        F.when(F.col("status") != "FAILED", F.least(F.lit(100.0), F.col("quality_score") + 10)).alias(
            "final_score"
        ),
    )
    done = (F.col("execution_status") == "COMPLETED") & F.col("action_type").startswith("EXECUTED")
    return W.completion(actions.where("execution_status = 'PENDING_APPROVAL'"), actions.where(done), scores)
