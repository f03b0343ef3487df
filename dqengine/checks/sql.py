"""Builders for the repetitive parts of the check SQL."""

from __future__ import annotations

from dqengine.schemas import DEFAULT_THRESHOLDS, SeverityThresholds

COLUMNS = {
    "lineitem_dirty": (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
        "l_returnflag l_linestatus l_shipdate"
    ).split(),
    "events_dirty": "event_id ts user_id event_type value props".split(),
    "documents_labeled": "doc_id lang source n_chars quality toxic".split(),
}
NUMERIC = {
    "lineitem_dirty": COLUMNS["lineitem_dirty"][:8],
    "events_dirty": ["event_id", "user_id", "value"],
    "documents_labeled": ["doc_id", "n_chars", "quality", "toxic"],
}
VIEWS = tuple(COLUMNS)


def null_sum(view: str, column: str) -> str:
    return f"select '{column}' as column_name, count(*) - count({column}) as affected_rows from {view}"


def z(column: str, view: str) -> str:
    return (
        f"abs({column} - (select avg({column}) from {view})) "
        f"/ nullif((select stddev_samp({column}) from {view}), 0)"
    )


def outlier_sum(view: str, column: str) -> str:
    return (
        f"select '{column}' as column_name, count(*) filter (where {z(column, view)} > 3) "
        f"as affected_rows from {view}"
    )


def duplicate_sum(view: str) -> str:
    return (
        f"(select count(*) from {view}) - (select count(*) from (select distinct * from {view}))"
    )


def grade(kind: str, share: str, t: SeverityThresholds) -> str:
    high, medium = getattr(t, f"{kind}_high"), getattr(t, f"{kind}_medium")
    return (
        f"case when {share} > {high} then 'HIGH' when {share} > {medium} then 'MEDIUM' else 'LOW' end"
    )


def grade_by_type(share: str, t: SeverityThresholds = DEFAULT_THRESHOLDS) -> str:
    return (
        f"case when issue_type = 'NULL_VALUES' then {grade('null', share, t)} "
        f"when issue_type like 'DUPLICATES%' then {grade('duplicate', share, t)} "
        f"else {grade('outlier', share, t)} end"
    )


def issues_cte(
    view: str, t: SeverityThresholds = DEFAULT_THRESHOLDS, name: str = "issues", source: str | None = None
) -> str:
    """``name as (...)``: exact issues of ``view``; ``source`` reads another relation of its shape."""
    rel = source or view
    parts = [f"select 'NULL_VALUES' as issue_type, * from ({null_sum(rel, c)})" for c in COLUMNS[view]]
    parts.append(
        f"select 'DUPLICATES', cast(null as varchar), {duplicate_sum(rel)}"
    )
    parts += [f"select 'OUTLIERS', * from ({outlier_sum(rel, c)})" for c in NUMERIC[view]]
    share = "(100e0 * affected_rows / total_rows)"
    return (
        f"{name} as (select issue_type, column_name, cast(affected_rows as bigint) as affected_rows, "
        f"total_rows, round({share}, 2) as percentage, {grade_by_type(share, t)} as severity, "
        f"'full_scan' as analysis_method from ({' union all '.join(parts)}), "
        f"(select count(*) as total_rows from {rel}) where affected_rows > 0)"
    )


def score() -> str:
    return "greatest(0e0, 100e0 - coalesce(100e0 * sum(affected_rows) / max(total_rows), 0e0))"
