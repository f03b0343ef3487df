"""Registered learning-history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqengine.checks.planning import plan_ctes
from dqengine.checks.registry import check
from dqengine.checks.sql import issues_cte
from dqengine.operators import learning as L
from dqengine.operators.profile import find_issues
from dqengine.plans.repair_plan import plan_for
from dqengine.schemas import SeverityThresholds
from dqengine.session import scratch_path
from dqengine.sources.views import EVENT_CLOCK, table

LOG = ("learning_log",)
NOW = f"timestamp '{EVENT_CLOCK}'"
PATTERNS = (
    "patterns as (select agent_name, concat(action_type, '_', context) as pattern, min(action_type) as action_type, "
    "min(context) as context, count(*) as attempts, count(*) filter (where success_score = 1) as successes, "
    "max(logged_at) as last_updated from learning_log group by all), "
    "rated as (select *, successes * 1e0 / attempts as success_rate, least(attempts / 10e0, 1e0) as confidence from patterns)"
)
GOOD = "confidence > 0.3 and success_rate > 0.7"


def _patterns(spark, d):
    return L.learning_patterns(table(spark, d, "learning_log"))


def _within(column: str, days: int) -> str:
    return f"{column} >= {NOW} - interval '{days}' day and {column} <= {NOW}"


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@check(
    "a01_outcome_rows",
    LOG,
    "select agent_name, action_type, context, execution_time, logged_at, "
    "case when success_score = 1 then 'SUCCESS' else 'FAILED' end as outcome, "
    "case when success_score = 1 then 1e0 else 0e0 end as success_score from learning_log",
)
def a01(spark, d):
    log = table(spark, d, "learning_log")
    return L.outcome_rows(
        log.select(
            "agent_name", "action_type", "context", "execution_time", "logged_at",
            (F.col("success_score") == 1).alias("success"),
        )
    )


@check(
    "a02_learning_patterns",
    LOG,
    f"with {PATTERNS} select agent_name, pattern, action_type, context, attempts, successes, "
    "round(success_rate, 6) as success_rate, round(confidence, 6) as confidence, last_updated from rated",
)
def a02(spark, d):
    return _rounded(_patterns(spark, d), "success_rate", "confidence")


@check(
    "a03_agent_recommendations",
    LOG,
    f"with {PATTERNS} select agent_name, round(least(avg(confidence), 1e0), 6) as overall_confidence, "
    "count(*) as confident_patterns, count(*) filter (where success_rate > 0.7) as learned_patterns_count "
    "from rated where confidence > 0.3 group by agent_name",
)
def a03(spark, d):
    return _rounded(L.agent_recommendations(_patterns(spark, d)), "overall_confidence")


@check(
    "a03_successful_patterns",
    LOG,
    f"with {PATTERNS} select agent_name, pattern, action_type, context, attempts, successes, "
    f"round(success_rate, 6) as success_rate, round(confidence, 6) as confidence, last_updated from rated where {GOOD}",
)
def a03_rows(spark, d):
    return _rounded(L.successful_patterns(_patterns(spark, d)), "success_rate", "confidence")


@check(
    "a04_learned_thresholds",
    LOG,
    f"with {PATTERNS} select cast(least(20, 15 + 2 * count(*) filter (where pattern like '%null_handling%' and success_rate > 0.8)) as double) as null_high, "
    "8e0 as null_medium, 10e0 as duplicate_high, 5e0 as duplicate_medium, 5e0 as outlier_high, 2e0 as outlier_medium, "
    "concat('completeness,consistency,validity', case when count(*) filter (where pattern like '%quality_analysis%' "
    f"and context = 'financial_data') > 0 then ',accuracy' else '' end) as focus_areas from rated where agent_name = 'DataQualityAgent' and {GOOD}",
)
def a04(spark, d):
    return L.learned_thresholds(_patterns(spark, d))


@check(
    "a05_learned_methods",
    LOG,
    f"with {PATTERNS}, c as (select *, case when pattern like '%FILL_MEDIAN%' and success_rate > 0.9 then 'FILL_MEDIAN' "
    "when pattern like '%FILL_MEAN%' and success_rate > 0.85 then 'FILL_MEAN' end as choice from rated "
    f"where agent_name = 'DataHealingAgent' and {GOOD}) "
    "select coalesce((select choice from c where choice is not null order by success_rate, confidence, pattern desc limit 1), 'FILL_MEDIAN') as numeric_nulls, "
    "'FILL_MODE' as categorical_nulls, 'KEEP_FIRST' as duplicates, 'CAP_OUTLIERS' as outliers",
)
def a05(spark, d):
    return L.learned_methods(_patterns(spark, d))


@check(
    "a06_learned_auto_approval",
    LOG,
    f"with {PATTERNS} select round(least(0.15e0, 0.1e0 + 0.02e0 * count(*) filter (where pattern like '%auto_approved%' and success_rate > 0.95)), 6) as auto_approval_threshold, "
    "85e0 as quality_score_threshold, 'HANDLE_NULLS,REMOVE_DUPLICATES' as safe_actions, 'HANDLE_OUTLIERS,DELETE_COLUMNS' as human_approval_needed "
    f"from rated where agent_name = 'PipelineOrchestrator' and {GOOD}",
)
def a06(spark, d):
    return _rounded(L.learned_auto_approval(_patterns(spark, d)), "auto_approval_threshold")


LIMITS = (
    "lim as (select cast(least(20, 15 + 2 * count(*) filter (where pattern like '%null_handling%' and success_rate > 0.8)) as double) as null_high "
    f"from rated where agent_name = 'DataQualityAgent' and {GOOD})"
)
LEARNED_LIMITS = SeverityThresholds("(select null_high from lim)", 8.0, 10.0, 5.0)


@check(
    "p11_graded_issues_learned_limits",
    ("lineitem_dirty", "learning_log"),
    f"with {PATTERNS}, {LIMITS}, {issues_cte('lineitem_dirty', LEARNED_LIMITS)} "
    "select issue_type, column_name, affected_rows, percentage, severity from issues",
)
def p11_learned(spark, d):
    learned = L.learned_inputs(_patterns(spark, d))
    issues = find_issues(table(spark, d, "lineitem_dirty"), learned.limits)
    return issues.select("issue_type", "column_name", "affected_rows", "percentage", "severity")


SURE = (
    "coalesce((select least(avg(confidence), 1e0) from rated where agent_name = 'DataHealingAgent' and confidence > 0.3), 0.5e0)"
)
CHOICE = (
    "(select coalesce((select choice from (select *, case when pattern like '%FILL_MEDIAN%' and success_rate > 0.9 then 'FILL_MEDIAN' "
    "when pattern like '%FILL_MEAN%' and success_rate > 0.85 then 'FILL_MEAN' end as choice from rated "
    f"where agent_name = 'DataHealingAgent' and {GOOD}) where choice is not null order by success_rate, confidence, pattern desc limit 1), "
    "'FILL_MEDIAN'))"
)


@check(
    "l04_actions_after_learning",
    ("lineitem_dirty", "learning_log"),
    f"with {PATTERNS}, "
    + plan_ctes("lineitem_dirty", SURE, f"{CHOICE}, 'FILL_MODE', 'KEEP_FIRST', 'CAP_OUTLIERS'")
    + " select action_id, recommended_method, severity, confidence, risk_level, disposition, approval_status from actions",
)
def l04_learned(spark, d):
    learned = L.learned_inputs(_patterns(spark, d))
    lines = table(spark, d, "lineitem_dirty")
    plan = plan_for(lines, find_issues(lines), learned.confidence, learned.methods)
    return plan.select(
        "action_id", "recommended_method", "severity", "confidence", "risk_level", "disposition", "approval_status"
    )


FEEDBACK = "action_id, agent_name, feedback_type, feedback_text, rating, context, feedback_at"


@check("a07_stored_feedback", ("feedback",), f"select {FEEDBACK} from feedback")
def a07(spark, d):
    path = scratch_path(spark, "feedback")
    L.store_feedback(table(spark, d, "feedback"), path)
    return spark.read.parquet(path)


PARSED = (
    "parsed as (select *, case when t like '%median%' then 'FILL_MEDIAN' when t like '%mean%' or t like '%average%' then 'FILL_MEAN' "
    "when t like '%mode%' or t like '%most common%' then 'FILL_MODE' end as suggested_method, "
    "case when t like '%outlier%' or t like '%cap%' then 'outliers' when t like '%null%' or t like '%missing%' or t like '%nan%' then 'nulls' "
    "when t like '%duplicate%' then 'duplicates' end as target, "
    "case when t like '%high%' or t like '%severe%' then 'HIGH' when t like '%low%' or t like '%minor%' then 'LOW' end as severity_hint "
    "from (select *, lower(coalesce(feedback_text, '')) as t from feedback))"
)


@check(
    "a08_parsed_feedback",
    ("feedback",),
    f"with {PARSED} select {FEEDBACK}, suggested_method, target, severity_hint from parsed",
)
def a08(spark, d):
    return L.parsed_feedback(table(spark, d, "feedback"))


def _reinforced(parsed: str) -> str:
    return (
        f"with {PATTERNS}, {parsed}, "
        "u as (select agent_name, coalesce(context, '') as context, feedback_at, action_id, 1 as part, "
        "case when rating >= 4 then 1.1e0 when rating <= 2 then 0.9e0 end as m from parsed union all "
        "select agent_name, case when coalesce(context, '') <> '' then context else target end, feedback_at, action_id, 2, "
        "case when rating >= 4 then 1.05e0 when rating <= 2 then 0.9e0 end from parsed where feedback_type = 'nlp_parsed'), "
        "j as (select p.agent_name, p.pattern, p.success_rate, p.confidence, "
        "list(u.m order by u.feedback_at, u.action_id, u.part) filter (where u.m is not null) as steps "
        "from rated p left join u on p.agent_name = u.agent_name and contains(p.pattern, u.context) group by all) "
        "select agent_name, pattern, "
        "round(list_reduce(list_prepend(success_rate, coalesce(steps, [])), lambda a, b: a * b), 6) as success_rate, "
        "round(list_reduce(list_prepend(confidence, coalesce(steps, [])), lambda a, b: least(1e0, a * b)), 6) as confidence from j"
    )


@check("a09_reinforced_patterns", ("learning_log", "feedback"), _reinforced(PARSED))
def a09(spark, d):
    result = L.reinforced_patterns(_patterns(spark, d), table(spark, d, "feedback"))
    return _rounded(result, "success_rate", "confidence")


#: Nine of ten feedbacks fall into one hour.
RUSH = (
    "(select * replace (case when action_id % 10 < 9 then timestamp '2024-01-15 10:00:00' + to_seconds(action_id % 3600) "
    "else feedback_at end as feedback_at) from feedback)"
)


@check("a09_reinforced_in_one_hour", ("learning_log", "feedback"), _reinforced(PARSED.replace("from feedback)", f"from {RUSH} f)")))
def a09_rush(spark, d):
    hour = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-15 10:00:00")) + F.col("action_id") % 3600)
    rush = F.when(F.col("action_id") % 10 < 9, hour).otherwise(F.col("feedback_at"))
    feedback = table(spark, d, "feedback").withColumn("feedback_at", rush)
    return _rounded(L.reinforced_patterns(_patterns(spark, d), feedback), "success_rate", "confidence")


BY_TYPE = (
    "words as (select *, regexp_split_to_array(lower(feedback_text), '\\s+') as w from feedback "
    f"where {_within('feedback_at', 30)}), "
    "by_type as (select agent_name, feedback_type, avg(rating) as avg_rating, count(*) as feedback_count, "
    + ", ".join(f"bool_or(list_contains(w, '{k}')) as has_{k}" for k in L.FEEDBACK_KEYWORDS)
    + " from words group by all)"
)


@check(
    "a10_feedback_by_type",
    ("feedback",),
    f"with {BY_TYPE} select agent_name, feedback_type, round(avg_rating, 6) as avg_rating, feedback_count, "
    "avg_rating < 3 as needs_improvement, concat_ws(',', "
    + ", ".join(f"case when has_{k} then '{k}' end" for k in L.FEEDBACK_KEYWORDS)
    + ") as common_suggestions from by_type",
)
def a10(spark, d):
    return _rounded(L.feedback_by_type(table(spark, d, "feedback"), EVENT_CLOCK), "avg_rating")


OVERVIEW = (
    f"{BY_TYPE}, overview as (select agent_name, sum(avg_rating * feedback_count) / sum(feedback_count) as overall_satisfaction, "
    "cast(sum(feedback_count) as bigint) as feedback_count, "
    "coalesce(string_agg(case when avg_rating < 3 then feedback_type end, ',' order by feedback_type), '') as improvement_areas "
    "from by_type group by agent_name)"
)


@check(
    "a10_feedback_overview",
    ("feedback",),
    f"with {OVERVIEW} select agent_name, round(overall_satisfaction, 6) as overall_satisfaction, feedback_count, improvement_areas from overview",
)
def a10_overview(spark, d):
    return _rounded(L.feedback_overview(table(spark, d, "feedback"), EVENT_CLOCK), "overall_satisfaction")


REJECTED = (
    "rejected as (select a.action_id, a.action_type, lower(coalesce(f.feedback_text, '')) as t from actions_log a "
    "left join feedback f on a.action_id = f.action_id where a.agent_name = 'HumanOperator' "
    f"and a.action_type like '%REJECTED%' and {_within('a.action_at', 60)}), "
    "bare as (select action_type as raw_action, regexp_replace(action_type, '^(BULK_)?REJECTED_(WITH_ALTERNATIVE_)?', '') as rejected_action, "
    "count(*) as rejections from rejected group by all), "
    "named as (select method, count(*) as mentions from rejected, (select unnest(["
    + ", ".join(f"'{m}'" for m in L.ALTERNATIVE_METHODS)
    + "]) as method) where contains(t, lower(method)) group by method)"
)
REJECTION_VIEWS = ("actions_log", "feedback")


def _rejection_inputs(spark, d):
    return table(spark, d, "actions_log"), table(spark, d, "feedback"), EVENT_CLOCK


@check(
    "a11_rejected_actions",
    REJECTION_VIEWS,
    f"with {REJECTED} select raw_action, rejected_action, rejections from bare",
)
def a11(spark, d):
    return L.rejected_actions(*_rejection_inputs(spark, d))


@check("a11_preferred_alternatives", REJECTION_VIEWS, f"with {REJECTED} select method, mentions from named")
def a11_alternatives(spark, d):
    return L.preferred_alternatives(*_rejection_inputs(spark, d))


@check(
    "a11_rejection_reasons",
    REJECTION_VIEWS,
    f"with {REJECTED} select reason, count(*) as mentions from rejected, (values "
    + ", ".join(f"('{k}', '{v}')" for k, v in L.REJECTION_REASONS.items())
    + ") r(phrase, reason) where contains(t, phrase) group by reason",
)
def a11_reasons(spark, d):
    return L.rejection_reasons(*_rejection_inputs(spark, d))


TOP_REJECTED = "(select rejected_action, sum(rejections) as n from bare group by 1 order by 2 desc, 1 limit {n})"
TOP_NAMED = "(select method, mentions as n from named order by 2 desc, 1 limit {n})"


@check(
    "a11_rejection_insights",
    REJECTION_VIEWS,
    f"with {REJECTED} select concat('Most frequently rejected action: ', rejected_action, ' (', n, ' times)') as insight "
    f"from {TOP_REJECTED.format(n=1)} union all select concat('Most preferred alternative: ', method, ' (', n, ' times)') "
    f"from {TOP_NAMED.format(n=1)}",
)
def a11_insights(spark, d):
    return L.rejection_insights(*_rejection_inputs(spark, d))


@check(
    "a12_learning_history",
    LOG,
    "select agent_name, action_type, round(avg(success_score), 6) as success_rate, count(*) as action_count, "
    f"round(least(count(*) / 10e0, 1e0), 6) as confidence from learning_log where {_within('logged_at', 90)} group by all",
)
def a12(spark, d):
    history = L.learning_history(table(spark, d, "learning_log"), EVENT_CLOCK)
    return _rounded(history, "success_rate", "confidence")


def _agents(spark, d):
    return table(spark, d, "actions_log").select("agent_name").union(
        table(spark, d, "learning_log").select("agent_name")
    ).distinct()


AGENTS = "agents as (select agent_name from actions_log union select agent_name from learning_log)"
BOTH = ("actions_log", "learning_log")


@check(
    "a13_success_rates",
    BOTH,
    f"with {AGENTS} select agent_name, round(coalesce(r, 100e0), 6) as success_rate from agents left join "
    f"(select agent_name, avg(success_score) * 100 as r from learning_log where {_within('logged_at', 30)} group by 1) using (agent_name)",
)
def a13(spark, d):
    rates = L.success_rates(table(spark, d, "learning_log"), _agents(spark, d), EVENT_CLOCK)
    return _rounded(rates, "success_rate")


@check(
    "a14_action_counts",
    BOTH,
    f"with {AGENTS} select agent_name, coalesce(n, 0) as total_actions from agents left join "
    f"(select agent_name, count(*) as n from learning_log where {_within('logged_at', 30)} group by 1) using (agent_name)",
)
def a14(spark, d):
    return L.action_counts(table(spark, d, "learning_log"), _agents(spark, d), EVENT_CLOCK)


KINDS = (
    "kinds as (select agent_name, action_type, r, n, case when r >= 0.8 then 'success' when r <= 0.4 then 'failure' end as kind from "
    f"(select agent_name, action_type, avg(success_score) as r, count(*) as n from learning_log where {_within('logged_at', 60)} "
    "group by all having count(*) >= 3))"
)


@check(
    "a15_success_failure_patterns",
    LOG,
    f"with {KINDS} select agent_name, kind, printf('%s (Success: %.1f%%, Count: %d)', action_type, r * 100, n) as description "
    "from kinds where kind is not null",
)
def a15(spark, d):
    return L.success_failure_patterns(table(spark, d, "learning_log"), EVENT_CLOCK)


@check(
    "a16_learning_summary",
    (*BOTH, "feedback"),
    f"with {AGENTS}, {KINDS}, {OVERVIEW}, "
    f"h as (select agent_name, count(*) as n, avg(success_score) * 100 as r from learning_log where {_within('logged_at', 90)} group by 1), "
    "k as (select agent_name, count(*) filter (where kind = 'success') as s, count(*) filter (where kind = 'failure') as f from kinds group by 1) "
    "select agent_name, coalesce(n, 0) as total_actions, round(coalesce(r, 100e0), 6) as success_rate, "
    "case when coalesce(n, 0) > 50 then 'high' when coalesce(n, 0) > 20 then 'medium' else 'low' end as learning_confidence, "
    "coalesce(s, 0) as successful_patterns, coalesce(f, 0) as failure_patterns, "
    "round(coalesce(overall_satisfaction, 0), 6) as overall_satisfaction, coalesce(feedback_count, 0) as feedback_count "
    "from agents left join h using (agent_name) left join k using (agent_name) left join overview using (agent_name)",
)
def a16(spark, d):
    summary = L.learning_summary(
        table(spark, d, "learning_log"), table(spark, d, "feedback"), _agents(spark, d), EVENT_CLOCK
    )
    return _rounded(summary, "success_rate", "overall_satisfaction")


@check(
    "a17_top_rejected_actions",
    REJECTION_VIEWS,
    f"with {REJECTED} select array_to_string(list_transform(string_split(rejected_action, '_'), "
    "lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') as rejected_action, cast(n as bigint) as rejections "
    f"from {TOP_REJECTED.format(n=3)}",
)
def a17(spark, d):
    return L.top_rejections(L.rejected_actions(*_rejection_inputs(spark, d)))


@check(
    "a17_top_alternatives",
    REJECTION_VIEWS,
    f"with {REJECTED} select method, n as mentions from {TOP_NAMED.format(n=3)}",
)
def a17_alternatives(spark, d):
    return L.top_alternatives(L.preferred_alternatives(*_rejection_inputs(spark, d)))
