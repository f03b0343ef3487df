"""Registered repair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqengine.checks.planning import plan_ctes
from dqengine.checks.registry import check
from dqengine.checks.sql import COLUMNS, NUMERIC, VIEWS, duplicate_sum, issues_cte, score, z
from dqengine.operators.duplicates import keep_one_per_key
from dqengine.operators.heal import Action, compare_before_after, heal, heal_by_group, repair
from dqengine.plans import workflows as W
from dqengine.schemas import HANDLE_NULLS, HANDLE_OUTLIERS, REMOVE_DUPLICATES
from dqengine.sources.views import table

LI, EV, DOC = VIEWS


def replaced(view: str, source: str | None = None, **expressions: str) -> str:
    """``select`` of all columns of a view with some replaced."""
    columns = [f"{expressions[c]} as {c}" if c in expressions else c for c in COLUMNS[view]]
    return f"select {', '.join(columns)} from {source or view}"


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


MODE = "(select {c} from {r} where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"


@check(
    "h01_fill_mean",
    (LI,),
    "with a as (select avg(l_quantity) as mean from " + LI + ") "
    + replaced(LI, f"{LI}, a", l_quantity="round(coalesce(l_quantity, mean), 6)"),
)
def h01(spark, d):
    return rounded(repair(table(spark, d, LI), "FILL_MEAN", "l_quantity"), "l_quantity")


@check(
    "h02_fill_median",
    (EV,),
    replaced(EV, value=f"round(coalesce(value, (select median(value) from {EV})), 6)"),
)
def h02(spark, d):
    return rounded(repair(table(spark, d, EV), "FILL_MEDIAN", "value"), "value")


@check(
    "h03_fill_mode",
    (LI,),
    replaced(LI, l_returnflag=f"coalesce(l_returnflag, {MODE.format(c='l_returnflag', r=LI)})"),
)
def h03(spark, d):
    return repair(table(spark, d, LI), "FILL_MODE", "l_returnflag")


@check(
    "h03_fill_mode_of_timestamps",
    (EV,),
    replaced(EV, ts=f"coalesce(ts, {MODE.format(c='ts', r=EV)})"),
)
def h03_ts(spark, d):
    return repair(table(spark, d, EV), "FILL_MODE", "ts")


@check("h04_fill_default", (LI,), replaced(LI, l_linestatus="coalesce(l_linestatus, 'Unknown')"))
def h04(spark, d):
    return repair(table(spark, d, LI), "FILL_DEFAULT", "l_linestatus")


@check("h05_delete_rows", (LI,), f"select * from {LI} where l_returnflag is not null")
def h05(spark, d):
    return repair(table(spark, d, LI), "DELETE_ROWS", "l_returnflag")


@check("h06_keep_first", (LI,), f"select distinct * from {LI}")
def h06(spark, d):
    return repair(table(spark, d, LI), "KEEP_FIRST")


@check("h06_keep_first_by_fingerprint", (LI,), f"select distinct * from {LI}")
def h06_fingerprint(spark, d):
    return repair(table(spark, d, LI), "KEEP_FIRST", fingerprint_rows=0)


@check("h07_keep_last", (EV,), f"select distinct * from {EV}")
def h07(spark, d):
    return repair(table(spark, d, EV), "KEEP_LAST")


@check(
    "h07_keep_last_by_key",
    (EV,),
    f"select {', '.join(COLUMNS[EV])} from {EV} qualify row_number() over (partition by user_id, event_type "
    "order by ts desc nulls last, event_id desc) = 1",
)
def h07_keyed(spark, d):
    return keep_one_per_key(table(spark, d, EV), ["user_id", "event_type"], ["ts", "event_id"], "last")


@check(
    "h08_cap_outliers",
    (LI,),
    replaced(
        LI,
        l_extendedprice=f"round(case when l_extendedprice > (select quantile_cont(l_extendedprice, 0.95) from {LI}) "
        f"then (select quantile_cont(l_extendedprice, 0.95) from {LI}) else l_extendedprice end, 4)",
    ),
)
def h08(spark, d):
    return rounded(
        repair(table(spark, d, LI), "CAP_OUTLIERS", "l_extendedprice"), "l_extendedprice", digits=4
    )


@check("h09_remove_outliers", (EV,), f"select * from {EV} where {z('value', EV)} <= 3")
def h09(spark, d):
    return repair(table(spark, d, EV), "REMOVE_OUTLIERS", "value")


@check(
    "h10_log_transform",
    (LI,),
    replaced(LI, l_extendedprice="round(case when l_extendedprice > -1 then ln(1 + l_extendedprice) end, 6)"),
)
def h10(spark, d):
    return rounded(repair(table(spark, d, LI), "LOG_TRANSFORM", "l_extendedprice"), "l_extendedprice")


STEPS = [
    Action(HANDLE_NULLS, "FILL_MEAN", "l_quantity"),
    Action(HANDLE_NULLS, "FILL_MODE", "l_returnflag"),
    Action(HANDLE_NULLS, "DELETE_ROWS", "l_linestatus"),
    Action(REMOVE_DUPLICATES, "KEEP_FIRST"),
    Action(HANDLE_OUTLIERS, "CAP_OUTLIERS", "l_extendedprice"),
]
STEP_CTES = (
    "s2 as ("
    + replaced(
        LI,
        l_quantity=f"coalesce(l_quantity, (select avg(l_quantity) from {LI}))",
        l_returnflag=f"coalesce(l_returnflag, {MODE.format(c='l_returnflag', r=LI)})",
    )
    + "), s3 as (select * from s2 where l_linestatus is not null), s4 as (select distinct * from s3), "
    "s5 as (select quantile_cont(l_extendedprice, 0.95) as p95 from s4)"
)


@check(
    "h11_sequential_repair",
    (LI,),
    f"with {STEP_CTES} "
    + replaced(
        LI,
        "s4, s5",
        l_quantity="round(l_quantity, 6)",
        l_extendedprice="round(case when l_extendedprice > p95 then p95 else l_extendedprice end, 4)",
    ),
)
def h11(spark, d):
    healed = heal(table(spark, d, LI), STEPS, measure=False).df
    return rounded(rounded(healed, "l_quantity"), "l_extendedprice", digits=4)


GROUP_STEPS = [
    Action(HANDLE_NULLS, "FILL_MEDIAN", "l_quantity"),
    Action(HANDLE_NULLS, "FILL_MODE", "l_linestatus"),
    Action(REMOVE_DUPLICATES, "KEEP_FIRST"),
    Action(HANDLE_OUTLIERS, "CAP_OUTLIERS", "l_extendedprice"),
]


@check(
    "h12_group_scoped_repair",
    (LI,),
    f"with g as (select l_suppkey, median(l_quantity) as med from {LI} group by l_suppkey), "
    f"m as (select l_suppkey, l_linestatus as status_mode from {LI} where l_linestatus is not null "
    "group by l_suppkey, l_linestatus qualify row_number() over (partition by l_suppkey order by count(*) desc, l_linestatus) = 1), "
    "f as ("
    + replaced(
        LI,
        f"{LI} left join g using (l_suppkey) left join m using (l_suppkey)",
        l_quantity="coalesce(l_quantity, med)",
        l_linestatus="coalesce(l_linestatus, status_mode)",
    )
    + "), u as (select distinct * from f), "
    "c as (select l_suppkey, quantile_cont(l_extendedprice, 0.95) as p95 from u group by l_suppkey) "
    + replaced(
        LI,
        "u join c using (l_suppkey)",
        l_extendedprice="round(case when l_extendedprice > p95 then p95 else l_extendedprice end, 4)",
    ),
)
def h12(spark, d):
    healed = heal_by_group(table(spark, d, LI), GROUP_STEPS, ["l_suppkey"])
    return rounded(healed, "l_extendedprice", digits=4)


def _changed_sql() -> str:
    total = f"(select count(*) from {LI})"
    kept = "(select count(*) from s3)"
    left = "(select count(*) from s4)"
    rows = [
        ("HANDLE_NULLS:l_quantity", "FILL_MEAN", total, total, f"(select count(*) from {LI} where l_quantity is null)"),
        ("HANDLE_NULLS:l_returnflag", "FILL_MODE", total, total, f"(select count(*) from {LI} where l_returnflag is null)"),
        ("HANDLE_NULLS:l_linestatus", "DELETE_ROWS", total, kept, "0"),
        ("REMOVE_DUPLICATES:*", "KEEP_FIRST", kept, left, "0"),
        ("HANDLE_OUTLIERS:l_extendedprice", "CAP_OUTLIERS", left, left, "(select count(*) from s4, s5 where l_extendedprice > p95)"),
    ]
    return " union all ".join(
        f"select cast({i + 1} as integer) as step, '{a}' as action_id, '{m}' as method, {b} as rows_before, "
        f"{n} as rows_after, {b} - {n} as records_affected, cast({c} as bigint) as cells_changed, true as success"
        for i, (a, m, b, n, c) in enumerate(rows)
    )


@check("h13_execution_log", (LI,), f"with {STEP_CTES} {_changed_sql()}")
def h13(spark, d):
    return heal(table(spark, d, LI), STEPS).log.select(
        "step", "action_id", "method", "rows_before", "rows_after", "records_affected", "cells_changed", "success"
    )


def _phase(phase: str, rel: str) -> str:
    nulls = " + ".join(f"(count(*) - count({c}))" for c in COLUMNS[LI])
    return (
        f"select '{phase}' as phase, count(*) as total_rows, {nulls} as missing_cells, "
        f"{duplicate_sum(rel)} as duplicates from {rel}"
    )


@check(
    "h14_before_after",
    (LI,),
    f"with {STEP_CTES} {_phase('before', LI)} union all {_phase('after', 's4')}",
)
def h14(spark, d):
    lines = table(spark, d, LI)
    return compare_before_after(lines, heal(lines, STEPS[:4], measure=False).df)


FULL_REPAIR = (
    "f as ("
    + replaced(
        LI,
        l_quantity=f"coalesce(l_quantity, (select median(l_quantity) from {LI}))",
        l_returnflag=f"coalesce(l_returnflag, {MODE.format(c='l_returnflag', r=LI)})",
        l_linestatus=f"coalesce(l_linestatus, {MODE.format(c='l_linestatus', r=LI)})",
    )
    + "), healed as (select distinct * from f)"
)


@check(
    "h15_validation_report",
    (LI,),
    f"with {FULL_REPAIR}, {issues_cte(LI)}, {issues_cte(LI, name='rest', source='healed')}, "
    f"o as (select {score()} as s, count(*) as n from issues), r as (select {score()} as s, count(*) as n from rest) "
    "select round(o.s, 4) as original_quality_score, round(r.s, 4) as final_quality_score, "
    "round(r.s - o.s, 4) as quality_improvement, o.n as original_issues_count, r.n as final_issues_count, "
    "o.n - r.n as issues_resolved, cast(4 as bigint) as healing_actions_executed, "
    "case when r.s >= o.s then 'PASSED' else 'IMPROVEMENT_NEEDED' end as validation_status from o, r",
)
def h15(spark, d):
    report = W.repair_feed(table(spark, d, LI), "lineitem", measure=False).validation
    scores = [c for c in report.columns if c.endswith("score") or c.endswith("improvement")]
    return rounded(report, *scores, digits=4)


@check("h16_repaired_feed", (LI,), f"with {FULL_REPAIR} select * from healed")
def h16(spark, d):
    return W.repair_feed(table(spark, d, LI), "lineitem", measure=False).healed.df


@check(
    "h17_processed_dataset",
    (EV,),
    f"with {plan_ctes(EV, '0.95e0')}, "
    f"healed as (select distinct * from ({replaced(EV, value=f'coalesce(value, (select median(value) from {EV}))')})), "
    f"c as (select (select count(*) from healed) as n, "
    + "("
    + " + ".join(f"(select count(*) from healed where {c} is null)" for c in COLUMNS[EV])
    + ") as nulls, "
    + " + ".join(f"(select count(*) from healed where {z(c, 'healed')} > 3)" for c in NUMERIC[EV])
    + " as outliers), "
    f"s as (select {score()} as score, count(*) as issue_count, max(total_rows) as total_records from issues) "
    "select 'events' as dataset_name, total_records, issue_count, round(score, 4) as quality_score, "
    "case when (select count(*) from actions where approval_status = 'NEEDS_APPROVAL') > 0 then 'PENDING_APPROVAL' else 'COMPLETED' end as status, "
    "round(greatest(0e0, 100e0 - 100e0 * (nulls + outliers) / n), 4) as final_quality_score from s, c",
)
def h17(spark, d):
    done = W.process_dataset(table(spark, d, EV), "events", learning_confidence=0.95)
    return rounded(
        done.summary.select(
            "dataset_name", "total_records", "issue_count", "quality_score", "status", "final_quality_score"
        ),
        "quality_score",
        "final_quality_score",
        digits=4,
    )


def _log_sql(view: str, dataset: str) -> str:
    n = len(COLUMNS[view])
    done = "'COMPLETED', null"
    return (
        f"with {plan_ctes(view)}, s as (select {score()} as score, count(*) as n, max(total_rows) as total from issues), "
        "w as (select case when count(*) > 0 then 'PENDING_APPROVAL' else 'COMPLETED' end as status from actions "
        "where approval_status = 'NEEDS_APPROVAL') "
        "select 'PipelineOrchestrator' as agent_name, 'DATASET_PROCESSING_START' as action_type, "
        f"printf('Starting processing for {dataset} (%d records, {n} columns)', total) as action_details, "
        "'COMPLETED' as execution_status, cast(null as varchar) as human_approval from s union all "
        "select 'DataQualityAgent', 'QUALITY_ANALYSIS_COMPLETE', "
        f"printf('Analysis complete - Quality Score: %.1f/100, Issues Found: %d', score, n), {done} from s union all "
        "select 'DataQualityAgent', concat('ISSUE_DETECTED_', issue_type), concat('Column ', chr(39), "
        "coalesce(column_name, 'Multiple'), chr(39), ': ', affected_rows, ' rows affected (', percentage, "
        f"'%) - Severity: ', severity), {done} from issues union all "
        "select 'DataHealingAgent', 'HEALING_PLAN_COMPLETE', concat('Generated ', count(*), ' healing actions: ', "
        f"string_agg(distinct action_type, ', ' order by action_type)), {done} from actions union all "
        "select 'DataHealingAgent', concat('HEALING_PROPOSED_', action_type), "
        "concat(printf('Proposed %s (confidence: %.0f%%) for column ', action_type, confidence * 100), chr(39), "
        "coalesce(column_name, 'multiple'), chr(39), printf(' affecting %d records', affected_rows)), "
        "'PENDING_APPROVAL', null from actions union all "
        "select 'PipelineOrchestrator', concat('AUTO_APPROVED_', action_type), "
        "printf('Auto-approved %s severity action affecting %d records (%.1f%%) - below approval threshold', "
        "severity, affected_rows, share), 'COMPLETED', 'AUTO_APPROVED' from actions "
        "where approval_status = 'AUTO_APPROVED' union all "
        "select 'PipelineOrchestrator', 'DATASET_PROCESSING_COMPLETE', "
        f"printf('Processing complete for {dataset} - Status: %s, Quality Score: %.1f/100', status, score), {done} from s, w"
    )


@check("h17_processing_log", (LI,), _log_sql(LI, "lineitem"))
def h17_log(spark, d):
    return W.process_dataset(table(spark, d, LI), "lineitem").action_log


for _method, _name, _window in (
    ("FILL_FORWARD", "h18_fill_forward", "last_value(value ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row)"),
    ("FILL_BACKWARD", "h18_fill_backward", "first_value(value ignore nulls) over (partition by user_id order by event_id rows between current row and unbounded following)"),
):
    check(_name, (EV,), replaced(EV, value=_window))(
        lambda spark, d, m=_method: repair(
            table(spark, d, EV), m, "value", keys=["user_id"], order_by=["event_id"]
        )
    )


for _method, _name, _window in (
    ("FILL_FORWARD", "h18_fill_forward_in_ranges", "last_value(value ignore nulls) over (order by ts nulls first, event_id rows between unbounded preceding and current row)"),
    ("FILL_BACKWARD", "h18_fill_backward_in_ranges", "first_value(value ignore nulls) over (order by ts nulls first, event_id rows between current row and unbounded following)"),
):
    # No key, a timestamp first, and ranges far smaller than the table.
    check(_name, (EV,), replaced(EV, value=_window))(
        lambda spark, d, m=_method: repair(
            table(spark, d, EV), m, "value", order_by=["ts", "event_id"], rows_per_chunk=300
        )
    )


@check("h18_drop_rows", (EV,), f"select * from {EV} where event_type is not null")
def h18_rows(spark, d):
    return repair(table(spark, d, EV), "DROP_ROWS", "event_type")


@check("h18_drop_columns", (EV,), f"select event_id, ts, user_id, event_type, value from {EV}")
def h18_columns(spark, d):
    return repair(table(spark, d, EV), "DROP_COLUMNS", "props")


@check(
    "h18_outlier_iqr",
    (EV,),
    f"with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from {EV}) "
    + replaced(
        EV,
        f"{EV}, q",
        value="round(case when value > b + 1.5e0 * (b - a) then b + 1.5e0 * (b - a) "
        "when value < a - 1.5e0 * (b - a) then a - 1.5e0 * (b - a) else value end, 6)",
    ),
)
def h18_iqr(spark, d):
    return rounded(repair(table(spark, d, EV), "OUTLIER_IQR", "value"), "value")


@check("h18_outlier_zscore", (EV,), f"select * from {EV} where {z('value', EV)} <= 3")
def h18_z(spark, d):
    return repair(table(spark, d, EV), "OUTLIER_ZSCORE", "value")


@check(
    "h18_outlier_percentile",
    (EV,),
    f"with q as (select quantile_cont(value, 0.05) as a, quantile_cont(value, 0.95) as b from {EV}) "
    + replaced(EV, f"{EV}, q", value="round(case when value > b then b when value < a then a else value end, 6)"),
)
def h18_percentile(spark, d):
    return rounded(repair(table(spark, d, EV), "OUTLIER_PERCENTILE", "value"), "value")


for _method in ("DUPLICATE_REMOVE", "DUPLICATE_KEEP_FIRST", "DUPLICATE_KEEP_LAST"):
    check(f"h18_{_method.lower()}", (EV,), f"select distinct * from {EV}")(
        lambda spark, d, m=_method: repair(table(spark, d, EV), m)
    )


@check(
    "h18_custom_transformation",
    (LI,),
    replaced(LI, l_extendedprice="abs(l_extendedprice)"),
)
def h18_custom(spark, d):
    return repair(
        table(spark, d, LI),
        "CUSTOM_TRANSFORMATION",
        transform=lambda df: df.withColumn("l_extendedprice", F.abs("l_extendedprice")),
    )
