"""Registered queries of repair planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqengine.checks.registry import check
from dqengine.checks.sql import NUMERIC, VIEWS, issues_cte
from dqengine.operators.profile import find_issues
from dqengine.plans import repair_plan as R
from dqengine.sources.views import table

LI, EV, DOC = VIEWS
SHORT = {LI: "lineitem", EV: "events", DOC: "documents"}


def _listed(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def stats_cte(view: str) -> str:
    rows = " union all ".join(
        f"select '{c}' as column_name, avg({c}) as mean_value, median({c}) as median_value, "
        f"stddev_samp({c}) as std_value from {view}"
        for c in NUMERIC[view]
    )
    return f"stats as ({rows})"


def confidence_sql(method: str, learned: str, preferred: str = "") -> str:
    known = f"({learned})"
    if preferred:
        known = f"case when {method} in ({preferred}) then least(1e0, {learned} + 0.15e0) else {learned} end"
    grade = "case when severity = 'LOW' then 0.9e0 when severity = 'HIGH' then 0.5e0 else 0.7e0 end"
    size = "case when share < 5 then 0.95e0 when share < 15 then 0.8e0 when share < 30 then 0.6e0 else 0.4e0 end"
    how = (
        f"case when is_numeric and {method} in ('FILL_MEAN', 'FILL_MEDIAN') then 0.85e0 "
        f"when {method} = 'DELETE_ROWS' and share > 20 then 0.5e0 else 0.7e0 end"
    )
    copies = "case when share < 10 then 0.95e0 when share < 30 then 0.75e0 else 0.6e0 end"
    cap = f"case when {method} = 'CAP_OUTLIERS' then 0.75e0 when {method} = 'REMOVE_OUTLIERS' then 0.65e0 else 0.7e0 end"
    mean = (
        f"case when action_type = 'HANDLE_NULLS' then ({size} + {how} + {known} + {grade}) / 4e0 "
        f"when action_type = 'REMOVE_DUPLICATES' then ({copies} + {known} + {grade}) / 3e0 "
        f"else ({cap} + {known} + {grade}) / 3e0 end"
    )
    return f"floor(({mean}) * 100e0 + 0.5e0) / 100e0"


def plan_ctes(view: str, learned: str = "0.5e0", preferred: str = "") -> str:
    return (
        f"{issues_cte(view)}, {stats_cte(view)}, "
        "typed as (select *, case when issue_type = 'NULL_VALUES' then 'HANDLE_NULLS' "
        "when issue_type = 'DUPLICATES' then 'REMOVE_DUPLICATES' "
        "when issue_type = 'OUTLIERS' and severity in ('HIGH', 'MEDIUM') then 'HANDLE_OUTLIERS' end as action_type, "
        f"coalesce(column_name in ({_listed(NUMERIC[view])}), false) as is_numeric, "
        "100e0 * affected_rows / total_rows as share from issues), "
        "chosen as (select *, case when action_type = 'HANDLE_NULLS' and is_numeric then 'FILL_MEDIAN' "
        "when action_type = 'HANDLE_NULLS' then 'FILL_MODE' when action_type = 'REMOVE_DUPLICATES' then 'KEEP_FIRST' "
        "else 'CAP_OUTLIERS' end as recommended_method from typed where action_type is not null), "
        f"sure as (select *, {confidence_sql('recommended_method', learned, preferred)} as confidence from chosen), "
        "risky as (select *, case when confidence >= 0.9 and severity = 'LOW' then 'LOW' "
        "when confidence >= 0.75 and severity in ('LOW', 'MEDIUM') then 'MEDIUM' else 'HIGH' end as risk_level from sure), "
        "split as (select *, case when confidence >= 0.9 and risk_level = 'LOW' then 'AUTO' else 'PENDING' end as disposition from risky), "
        "actions as (select concat(action_type, ':', coalesce(column_name, '*')) as action_id, *, "
        "case when disposition = 'AUTO' then 'AUTO_EXECUTED' when severity in ('HIGH', 'MEDIUM') or share > 10 "
        "then 'NEEDS_APPROVAL' else 'AUTO_APPROVED' end as approval_status, "
        "case action_type when 'HANDLE_NULLS' then 1 when 'REMOVE_DUPLICATES' then 2 else 3 end as execution_rank, "
        "printf('Affects %d records (%.1f%%)', affected_rows, share) as impact from split left join stats using (column_name))"
    )


def _plan(spark, d, view, learned=0.5, preferred=()):
    df = table(spark, d, view)
    return R.plan_for(df, find_issues(df), learned, preferred)


MAIN = (
    "action_id, action_type, column_name, affected_rows, severity, is_numeric, recommended_method, "
    "confidence, risk_level, disposition, approval_status, execution_rank, impact"
)

for _v in VIEWS:
    check(f"l01_proposed_actions_{SHORT[_v]}", (_v,), f"with {plan_ctes(_v)} select {MAIN} from actions")(
        lambda spark, d, v=_v: _plan(spark, d, v).select(*MAIN.split(", "))
    )


@check(
    "l02_recommended_methods",
    (DOC,),
    f"with {plan_ctes(DOC)} select action_id, action_type, column_name, recommended_method from actions",
)
def l02(spark, d):
    return _plan(spark, d, DOC).select("action_id", "action_type", "column_name", "recommended_method")


@check(
    "l03_action_options",
    (LI,),
    f"with {plan_ctes(LI)} select action_id, unnest(case "
    "when action_type = 'HANDLE_NULLS' and is_numeric then [{'method': 'FILL_MEAN', 'description': "
    "printf('Fill with mean value (%.2f)', mean_value)}, {'method': 'FILL_MEDIAN', 'description': "
    "printf('Fill with median value (%.2f)', median_value)}, {'method': 'DELETE_ROWS', 'description': "
    "printf('Delete %d rows with null values', affected_rows)}] "
    "when action_type = 'HANDLE_NULLS' then [{'method': 'FILL_MODE', 'description': 'Fill with most common value'}, "
    "{'method': 'FILL_DEFAULT', 'description': 'Fill with default value ''Unknown'''}, {'method': 'DELETE_ROWS', "
    "'description': printf('Delete %d rows with null values', affected_rows)}] "
    "when action_type = 'REMOVE_DUPLICATES' then [{'method': 'KEEP_FIRST', 'description': "
    "'Keep first occurrence of duplicates'}, {'method': 'KEEP_LAST', 'description': 'Keep last occurrence of duplicates'}] "
    "else [{'method': 'CAP_OUTLIERS', 'description': 'Cap outliers to 95th percentile'}, {'method': 'REMOVE_OUTLIERS', "
    "'description': 'Remove outlier records'}, {'method': 'LOG_TRANSFORM', 'description': 'Apply log transformation'}] end, "
    "recursive := true) from actions",
)
def l03(spark, d):
    return _plan(spark, d, LI).select("action_id", F.inline("options"))


@check(
    "l04_confidence_of_every_option",
    (DOC,),
    f"with {plan_ctes(DOC)}, o as (select *, unnest(case when action_type = 'HANDLE_NULLS' and is_numeric "
    "then ['FILL_MEAN', 'FILL_MEDIAN', 'DELETE_ROWS'] when action_type = 'HANDLE_NULLS' then "
    "['FILL_MODE', 'FILL_DEFAULT', 'DELETE_ROWS'] when action_type = 'REMOVE_DUPLICATES' then ['KEEP_FIRST', 'KEEP_LAST'] "
    "else ['CAP_OUTLIERS', 'REMOVE_OUTLIERS', 'LOG_TRANSFORM'] end) as method from actions) "
    "select action_id, method, "
    + confidence_sql("method", "0.5e0", "'FILL_MEAN', 'CAP_OUTLIERS'")
    + " as option_confidence from o",
)
def l04(spark, d):
    options = _plan(spark, d, DOC).withColumn("__share", F.col("affected_rows") / F.col("total_rows") * 100)
    flat = options.select("*", F.inline("options"))
    return flat.select(
        "action_id",
        "method",
        R.confidence(F.col("method"), F.lit(0.5), ("FILL_MEAN", "CAP_OUTLIERS")).alias("option_confidence"),
    )


@check(
    "l05_risk_levels_after_learning",
    (EV,),
    f"with {plan_ctes(EV, '0.95e0', _listed(['FILL_MEDIAN', 'KEEP_FIRST']))} "
    "select action_id, severity, confidence, risk_level, disposition from actions",
)
def l05(spark, d):
    plan = _plan(spark, d, EV, 0.95, ("FILL_MEDIAN", "KEEP_FIRST"))
    return plan.select("action_id", "severity", "confidence", "risk_level", "disposition")


@check(
    "l06_auto_pending_split",
    VIEWS,
    "".join(
        f"{' union all ' if i else ''}select '{SHORT[v]}' as dataset, disposition, actions from (with {plan_ctes(v, '0.95e0')} "
        "select disposition, count(*) as actions from actions group by disposition)"
        for i, v in enumerate(VIEWS)
    ),
)
def l06(spark, d):
    parts = [
        _plan(spark, d, v, 0.95)
        .groupBy("disposition")
        .agg(F.count("*").alias("actions"))
        .select(F.lit(SHORT[v]).alias("dataset"), "disposition", "actions")
        for v in VIEWS
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@check(
    "l07_approval_rule",
    (LI,),
    f"with {plan_ctes(LI)} select action_id, severity, affected_rows, approval_status from actions",
)
def l07(spark, d):
    return _plan(spark, d, LI).select("action_id", "severity", "affected_rows", "approval_status")


@check(
    "l08_reasoning",
    (LI,),
    f"with {plan_ctes(LI)} select action_id, concat_ws(' | ', "
    "case when action_type = 'HANDLE_NULLS' then printf('''%s'' lacks a value in %.1f%% of the rows (%d)', column_name, share, affected_rows) end, "
    "case when action_type = 'HANDLE_NULLS' and is_numeric then printf('Holds numbers with mean %.2f and median %.2f', mean_value, median_value) end, "
    "case when action_type = 'HANDLE_NULLS' and is_numeric then case when abs(mean_value - median_value) < std_value * 0.1 "
    "then 'Mean and median agree, so the values look symmetric' "
    "else 'Mean and median differ, so the values look skewed and the median is safer' end end, "
    "case when action_type = 'HANDLE_NULLS' and share < 5 then 'Few gaps: filling them changes little and keeps all rows' end, "
    "case when action_type = 'HANDLE_NULLS' and share > 30 then 'Many gaps: ask whether the column is worth keeping' end, "
    "case when action_type = 'REMOVE_DUPLICATES' then printf('%d rows repeat an earlier one (%.1f%% of the table)', affected_rows, share) end, "
    "case when action_type = 'REMOVE_DUPLICATES' then 'Repeated rows weigh too much in every total' end) as thoughts, "
    "concat_ws(' | ', case when recommended_method = 'FILL_MEDIAN' then 'FILL_MEAN (for symmetric values)' end, "
    "case when recommended_method = 'FILL_MEDIAN' then 'DELETE_ROWS (if the gaps follow a pattern)' end, "
    "case when action_type = 'REMOVE_DUPLICATES' then 'KEEP_LAST (if later rows are corrections)' end, "
    "case when action_type = 'REMOVE_DUPLICATES' then 'Review by hand (if rows may repeat on purpose)' end) as alternatives, "
    "concat_ws(' | ', case when action_type = 'HANDLE_NULLS' and share > 20 then printf('%.1f%% of the column would be invented values', share) end, "
    "case when action_type = 'REMOVE_DUPLICATES' and share > 20 then 'Rows that are rightly equal would go as well' end) as risks "
    "from actions",
)
def l08(spark, d):
    return _plan(spark, d, LI).select(
        "action_id", *[F.array_join(c, " | ").alias(c) for c in ("thoughts", "alternatives", "risks")]
    )


@check(
    "l09_execution_order",
    (LI,),
    f"with {plan_ctes(LI)} select action_id, cast(row_number() over (order by execution_rank, column_name) as integer) as step from actions",
)
def l09(spark, d):
    return R.with_steps(_plan(spark, d, LI)).select("action_id", "step")


@check(
    "l10_plan_summary",
    (LI,),
    f"with {plan_ctes(LI)} select count(*) as action_count, "
    "string_agg(distinct action_type, ', ' order by action_type) as action_types from actions",
)
def l10(spark, d):
    return R.plan_summary(_plan(spark, d, LI))


@check("l11_impact_text", (EV,), f"with {plan_ctes(EV)} select action_id, impact from actions")
def l11(spark, d):
    return _plan(spark, d, EV).select("action_id", "impact")


@check(
    "l12_approval_decisions",
    (LI,),
    f"with {plan_ctes(LI)} select action_id, case when severity = 'HIGH' then 'FILL_DEFAULT' else recommended_method end as method, "
    "case when severity = 'HIGH' then 'APPROVED' when severity = 'MEDIUM' then 'REJECTED' else approval_status end as decision from actions",
)
def l12(spark, d):
    plan = _plan(spark, d, LI)
    decisions = plan.where("severity <> 'LOW'").select(
        "action_id",
        (F.col("severity") == "HIGH").alias("approved"),
        F.when(F.col("severity") == "HIGH", "FILL_DEFAULT").alias("method"),
    )
    return R.apply_decisions(plan, decisions).select("action_id", "method", "decision")
