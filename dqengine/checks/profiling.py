"""Registered profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqengine.checks.registry import check
from dqengine.checks.sql import (
    COLUMNS,
    NUMERIC,
    VIEWS,
    duplicate_sum,
    grade,
    issues_cte,
    null_sum,
    outlier_sum,
    score,
)
from dqengine.operators import profile as P
from dqengine.operators.duplicates import duplicate_count
from dqengine.schemas import SAMPLED_THRESHOLDS
from dqengine.sources.views import table

LI, EV, DOC = VIEWS
ISSUES = "issue_type, column_name, affected_rows, total_rows, percentage, severity, analysis_method"


def _nulls_sql(view: str) -> str:
    return (
        f"select column_name, affected_rows, total_rows, "
        f"round(100e0 * affected_rows / total_rows, 2) as percentage from "
        f"({' union all '.join(null_sum(view, c) for c in COLUMNS[view])}), "
        f"(select count(*) as total_rows from {view}) where affected_rows > 0"
    )


def _iqr_ctes(view: str, source: str) -> str:
    rows = " union all ".join(
        f"select '{c}' as column_name, quantile_cont({c}::double, 0.25) as q1, "
        f"quantile_cont({c}::double, 0.75) as q3 from {source}"
        for c in NUMERIC[view]
    )
    return (
        f"b as (select *, q1 - 1.5e0 * (q3 - q1) as lower_bound, q3 + 1.5e0 * (q3 - q1) as upper_bound "
        f"from ({rows}))"
    )


def _iqr_counts(view: str) -> str:
    return " union all ".join(
        f"select '{c}' as column_name, (select count(*) from {view}, b where column_name = '{c}' "
        f"and ({c} < lower_bound or {c} > upper_bound)) as affected_rows"
        for c in NUMERIC[view]
    )


@check(
    "p01_shape",
    VIEWS,
    "".join(
        f"{'' if i == 0 else ' union all '}select '{v}' as dataset, count(*) as total_records, "
        f"cast({len(COLUMNS[v])} as bigint) as total_columns from {v}"
        for i, v in enumerate(VIEWS)
    ),
)
def p01(spark, d):
    parts = [P.shape(table(spark, d, v)).select(F.lit(v).alias("dataset"), "*") for v in VIEWS]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


for _v, _short in ((LI, "lineitem"), (EV, "events"), (DOC, "documents")):
    check(f"p02_null_profile_{_short}", (_v,), _nulls_sql(_v))(
        lambda spark, d, v=_v: P.null_counts(table(spark, d, v))
    )


@check(
    "p03_missing_cells",
    (LI,),
    f"select cast(sum(affected_rows) as bigint) as missing_cells from "
    f"({' union all '.join(null_sum(LI, c) for c in COLUMNS[LI])})",
)
def p03(spark, d):
    return P.missing_cells(table(spark, d, LI))


@check("p04_duplicate_rows", (LI,), f"select cast({duplicate_sum(LI)} as bigint) as duplicates")
def p04(spark, d):
    return duplicate_count(table(spark, d, LI))


@check(
    "p05_zscore_outliers",
    (EV,),
    f"select column_name, affected_rows, total_rows from "
    f"({' union all '.join(outlier_sum(EV, c) for c in NUMERIC[EV])}), "
    f"(select count(*) as total_rows from {EV})",
)
def p05(spark, d):
    return P.outlier_counts(table(spark, d, EV))


@check(
    "p06_iqr_outliers",
    (EV,),
    f"with {_iqr_ctes(EV, EV)} select column_name, affected_rows, total_rows from ({_iqr_counts(EV)}), "
    f"(select count(*) as total_rows from {EV})",
)
def p06(spark, d):
    return P.iqr_outlier_counts(table(spark, d, EV))


@check(
    "p06_iqr_bounds",
    (LI,),
    f"with {_iqr_ctes(LI, LI)} select column_name, round(q1, 4) as q1, round(q3, 4) as q3, "
    "round(lower_bound, 4) as lower_bound, round(upper_bound, 4) as upper_bound from b",
)
def p06_bounds(spark, d):
    bounds = P.iqr_bounds(table(spark, d, LI))
    return bounds.select(
        "column_name", *[F.round(c, 4).alias(c) for c in bounds.columns if c != "column_name"]
    )


QUARTER = "substr(md5(cast(l_orderkey as varchar)), 1, 4) < '4000'"


@check(
    "p07_estimated_duplicates",
    (LI,),
    f"with s as (select * from {LI} where {QUARTER}), "
    f"c as (select (select count(*) from s) as sampled_rows, {duplicate_sum('s')} as sampled_duplicates, "
    f"(select count(*) from {LI}) as total_rows) "
    "select sampled_rows, cast(sampled_duplicates as bigint) as sampled_duplicates, total_rows, "
    "cast(floor(sampled_duplicates * 1e0 / sampled_rows * total_rows) as bigint) as affected_rows from c",
)
def p07(spark, d):
    return P.estimated_duplicates(table(spark, d, LI), "l_orderkey", 0.25)


@check(
    "p08_sampled_iqr_outliers",
    (EV,),
    f"with s as (select * from {EV} where substr(md5(cast(event_id as varchar)), 1, 4) < '4000'), "
    f"{_iqr_ctes(EV, 's')} select column_name, affected_rows, total_rows from ({_iqr_counts(EV)}), "
    f"(select count(*) as total_rows from {EV})",
)
def p08(spark, d):
    events = table(spark, d, EV)
    return P.iqr_outlier_counts(events, bounds_from=P.hash_sample(events, "event_id", 0.25))


def _problem_ctes(view: str) -> str:
    null_any = " or ".join(f"{c} is null" for c in COLUMNS[view])
    outlier = " || ".join(
        f"case when {c} < (select lower_bound from b where column_name = '{c}') or "
        f"{c} > (select upper_bound from b where column_name = '{c}') "
        f"then ['OUTLIER:{c}'] else [] end"
        for c in NUMERIC[view]
    )
    return (
        f"{_iqr_ctes(view, view)}, "
        f"g as (select {', '.join(COLUMNS[view])}, count(*) as copies from {view} group by all), "
        f"r as (select *, case when {null_any} then ['NULL'] else [] end || {outlier} as other from g), "
        "p as (select *, other || case when copies > 1 then ['DUPLICATE'] else [] end as reasons, "
        "case when len(other) > 0 then copies else copies - 1 end as problem_rows from r)"
    )


@check(
    "p09_problem_rows",
    (EV,),
    f"with {_problem_ctes(EV)} select {', '.join(COLUMNS[EV])}, copies, problem_rows, "
    "array_to_string(reasons, ',') as reasons from p where len(reasons) > 0",
)
def p09(spark, d):
    rows = P.problem_rows(table(spark, d, EV))
    return rows.withColumn("reasons", F.array_join("reasons", ","))


@check(
    "p10_null_columns_in_problem_rows",
    (LI,),
    f"with {_problem_ctes(LI)}, q as (select * from p where len(reasons) > 0), "
    f"hit as ({' union all '.join(null_sum('q', c) for c in COLUMNS[LI])}) "
    f"select f.* from ({_nulls_sql(LI)}) f where f.column_name in "
    "(select column_name from hit where affected_rows > 0)",
)
def p10(spark, d):
    lines = table(spark, d, LI)
    return P.null_columns_in(P.problem_rows(lines), lines)


for _v, _short in ((LI, "lineitem"), (EV, "events"), (DOC, "documents")):
    check(f"p11_graded_issues_{_short}", (_v,), f"with {issues_cte(_v)} select {ISSUES} from issues")(
        lambda spark, d, v=_v: P.find_issues(table(spark, d, v))
    )
    check(
        f"p11_graded_issues_sampled_limits_{_short}",
        (_v,),
        f"with {issues_cte(_v, SAMPLED_THRESHOLDS)} select {ISSUES} from issues",
    )(lambda spark, d, v=_v: P.find_issues(table(spark, d, v), limits=SAMPLED_THRESHOLDS))
    check(
        f"p12_quality_score_{_short}",
        (_v,),
        f"with {issues_cte(_v)} select round({score()}, 4) as quality_score from issues",
    )(
        lambda spark, d, v=_v: P.quality_score(P.find_issues(table(spark, d, v))).select(
            F.round("quality_score", 4).alias("quality_score")
        )
    )


@check(
    "p13_recalculated_score",
    (LI,),
    f"with c as (select (select count(*) from {LI}) as total_rows, "
    f"(select cast(sum(affected_rows) as bigint) from ({' union all '.join(null_sum(LI, c) for c in COLUMNS[LI])})) as missing_cells, "
    f"cast({duplicate_sum(LI)} as bigint) as duplicates, "
    f"(select cast(sum(affected_rows) as bigint) from ({' union all '.join(outlier_sum(LI, c) for c in NUMERIC[LI])})) as outliers) "
    "select *, round(greatest(0e0, 100e0 - 100e0 * (missing_cells + duplicates + outliers) / total_rows), 4) "
    "as quality_score from c",
)
def p13(spark, d):
    return P.recalculated_score(table(spark, d, LI)).withColumn(
        "quality_score", F.round("quality_score", 4)
    )


@check("p14_exact_profile", (LI,), f"with {issues_cte(LI)} select {ISSUES} from issues")
def p14(spark, d):
    return P.profile(table(spark, d, LI))


@check(
    "p14_sampled_profile",
    (EV,),
    f"with s as (select * from {EV} where substr(md5(cast(event_id as varchar)), 1, 4) < '4000'), "
    f"{_iqr_ctes(EV, 's')}, "
    f"found as (select 'NULL_VALUES' as issue_type, column_name, affected_rows, 'selective_rows' as analysis_method "
    f"from ({' union all '.join(null_sum(EV, c) for c in COLUMNS[EV])}) union all "
    f"select 'DUPLICATES_ESTIMATED', null, cast(floor(({duplicate_sum('s')}) * 1e0 / (select count(*) from s) "
    f"* (select count(*) from {EV})) as bigint), 'sampled_estimation' union all "
    f"select 'OUTLIERS_ESTIMATED', column_name, affected_rows, 'statistical_estimation' from ({_iqr_counts(EV)})), "
    f"n as (select *, 100e0 * affected_rows / total_rows as share from found, "
    f"(select count(*) as total_rows from {EV}) where affected_rows > 0) "
    "select issue_type, column_name, affected_rows, total_rows, round(share, 2) as percentage, "
    f"case when issue_type = 'NULL_VALUES' then {grade('null', 'share', SAMPLED_THRESHOLDS)} "
    f"when issue_type like 'DUP%' then {grade('duplicate', 'share', SAMPLED_THRESHOLDS)} "
    f"else {grade('outlier', 'share', SAMPLED_THRESHOLDS)} end as severity, analysis_method from n",
)
def p14_sampled(spark, d):
    return P.find_issues_sampled(table(spark, d, EV), "event_id", 0.25)


@check(
    "p15_recommendations",
    (LI,),
    f"with {issues_cte(LI)} select {ISSUES}, case "
    "when issue_type = 'NULL_VALUES' and severity = 'HIGH' then concat('Critical: Fill or remove ', affected_rows, "
    "' null values in ', column_name, ' (', percentage, '%)') "
    "when issue_type = 'NULL_VALUES' then concat('Consider filling ', affected_rows, ' null values in ', column_name) "
    "when issue_type = 'DUPLICATES' and severity = 'HIGH' then concat('Critical: Remove ', affected_rows, "
    "' duplicate rows (', percentage, '%)') "
    "when issue_type = 'DUPLICATES' then concat('Review ', affected_rows, ' potential duplicate rows') "
    "else concat('Review ', affected_rows, ' outlier values in ', column_name, ' (', percentage, '%)') end "
    "as recommendation from issues",
)
def p15(spark, d):
    return P.recommendations(P.find_issues(table(spark, d, LI)))


@check(
    "p16_severity_breakdown",
    (LI,),
    f"with {issues_cte(LI)} select count(*) filter (where severity = 'HIGH') as high, "
    "count(*) filter (where severity = 'MEDIUM') as medium, count(*) filter (where severity = 'LOW') as low from issues",
)
def p16(spark, d):
    return P.severity_breakdown(P.find_issues(table(spark, d, LI)))


@check(
    "p17_score_tiers",
    ("datasets",),
    "select dataset_id, quality_score, case when quality_score >= 90 then 'Excellent' "
    "when quality_score >= 70 then 'Good' else 'Needs Healing' end as tier from datasets",
)
def p17(spark, d):
    return table(spark, d, "datasets").select(
        "dataset_id", "quality_score", P.score_tier(F.col("quality_score")).alias("tier")
    )


@check(
    "p18_score_bands",
    ("datasets",),
    "select case when quality_score >= 80 then 'green' when quality_score >= 60 then 'amber' else 'red' end as colour, "
    "case when quality_score >= 80 then 3 when quality_score >= 50 then 2 else 1 end as gauge_step, "
    "count(*) as datasets from datasets group by all",
)
def p18(spark, d):
    score_col = F.col("quality_score")
    return (
        table(spark, d, "datasets")
        .groupBy(P.score_colour(score_col).alias("colour"), P.gauge_step(score_col).alias("gauge_step"))
        .agg(F.count("*").alias("datasets"))
    )


@check(
    "p19_issue_chart",
    ("quality_issues",),
    "select issue_type, severity, cast(sum(affected_rows) as bigint) as affected_rows from quality_issues "
    "group by rollup (issue_type, severity)",
)
def p19(spark, d):
    return P.issue_chart(table(spark, d, "quality_issues"))


@check(
    "p20_top_issues",
    (LI,),
    f"with {issues_cte(LI)} select {ISSUES} from issues order by affected_rows desc, issue_type, "
    "column_name nulls first limit 3",
)
def p20(spark, d):
    return P.top_issues(P.find_issues(table(spark, d, LI)))


@check(
    "p20_needs_attention",
    (DOC,),
    f"with {issues_cte(DOC)} select 'documents' as dataset_name, max(total_rows) as total_records, "
    f"cast(6 as bigint) as total_columns, count(*) as issue_count, "
    "count(*) filter (where severity = 'HIGH') as high_issue_count, "
    f"round({score()}, 4) as quality_score, count(*) > 0 as needs_attention from issues",
)
def p20_attention(spark, d):
    documents = table(spark, d, DOC)
    return P.quality_report(documents, "documents", P.find_issues(documents)).withColumn(
        "quality_score", F.round("quality_score", 4)
    )
