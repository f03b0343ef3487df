"""From issues to proposed repairs: method, confidence, risk and who must approve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqengine.functions.columns import col, nan_to_null, numeric_columns, percent, round_cents
from dqengine.functions.quantiles import DIRECT_ROWS, exact_quantiles
from dqengine.operators.facts import Facts
from dqengine.operators.heal import Action
from dqengine.schemas import (
    DUPLICATES,
    EXECUTION_ORDER,
    HANDLE_NULLS,
    HANDLE_OUTLIERS,
    ISSUE_SCHEMA,
    NULL_VALUES,
    OUTLIERS,
    REMOVE_DUPLICATES,
)

DEFAULT_LEARNING_CONFIDENCE = 0.5

# Options offered per action, (method, description) in display order.
NULL_NUMERIC_METHODS = ("FILL_MEAN", "FILL_MEDIAN", "DELETE_ROWS")
NULL_TEXT_METHODS = ("FILL_MODE", "FILL_DEFAULT", "DELETE_ROWS")
DUPLICATE_OPTIONS = (
    ("KEEP_FIRST", "Keep first occurrence of duplicates"),
    ("KEEP_LAST", "Keep last occurrence of duplicates"),
)
OUTLIER_OPTIONS = (
    ("CAP_OUTLIERS", "Cap outliers to 95th percentile"),
    ("REMOVE_OUTLIERS", "Remove outlier records"),
    ("LOG_TRANSFORM", "Apply log transformation"),
)


def column_statistics(
    df: DataFrame, columns: Sequence[str] | None = None, direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """Rows ``(column_name, mean_value, median_value, std_value)`` of numeric columns."""
    df = nan_to_null(df)
    names = list(columns) if columns is not None else numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column_name string, mean_value double, std_value double, median_value double"
        )
    sums = []
    for i, c in enumerate(names):
        sums += [
            F.avg(col(c)).cast("double").alias(f"__m{i}"),
            F.stddev_samp(col(c).cast("double")).alias(f"__s{i}"),
        ]
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"__m{i}").alias("mean_value"),
            F.col(f"__s{i}").alias("std_value"),
        )
        for i, c in enumerate(names)
    ]
    moments = df.agg(F.count("*").alias("__n"), *sums).select(F.inline(F.array(*entries)))
    medians = exact_quantiles(df, names, [0.5], direct_rows=direct_rows).select(
        "column_name", F.col("value").alias("median_value")
    )
    return moments.join(medians, "column_name", "left")


def _action_type() -> Column:
    kind, grade = F.col("issue_type"), F.col("severity")
    return (
        F.when(kind == NULL_VALUES, HANDLE_NULLS)
        .when(kind == DUPLICATES, REMOVE_DUPLICATES)
        .when((kind == OUTLIERS) & grade.isin("HIGH", "MEDIUM"), HANDLE_OUTLIERS)
    )


def _recommended() -> Column:
    return (
        F.when((F.col("action_type") == HANDLE_NULLS) & F.col("is_numeric"), "FILL_MEDIAN")
        .when(F.col("action_type") == HANDLE_NULLS, "FILL_MODE")
        .when(F.col("action_type") == REMOVE_DUPLICATES, "KEEP_FIRST")
        .otherwise("CAP_OUTLIERS")
    )


def _option(method: str, description: Column) -> Column:
    return F.struct(F.lit(method).alias("method"), description.alias("description"))


def _options() -> Column:
    # These texts are results.
    delete = F.format_string("Delete %d rows with null values", F.col("affected_rows"))
    numeric = F.array(
        _option("FILL_MEAN", F.format_string("Fill with mean value (%.2f)", F.col("mean_value"))),
        _option("FILL_MEDIAN", F.format_string("Fill with median value (%.2f)", F.col("median_value"))),
        _option("DELETE_ROWS", delete),
    )
    text = F.array(
        _option("FILL_MODE", F.lit("Fill with most common value")),
        _option("FILL_DEFAULT", F.lit("Fill with default value 'Unknown'")),
        _option("DELETE_ROWS", delete),
    )
    fixed = {
        REMOVE_DUPLICATES: F.array(*[_option(m, F.lit(d)) for m, d in DUPLICATE_OPTIONS]),
        HANDLE_OUTLIERS: F.array(*[_option(m, F.lit(d)) for m, d in OUTLIER_OPTIONS]),
    }
    return (
        F.when((F.col("action_type") == HANDLE_NULLS) & F.col("is_numeric"), numeric)
        .when(F.col("action_type") == HANDLE_NULLS, text)
        .when(F.col("action_type") == REMOVE_DUPLICATES, fixed[REMOVE_DUPLICATES])
        .otherwise(fixed[HANDLE_OUTLIERS])
    )


def confidence(method: Column, learned: Column, preferred: Sequence[str] = ()) -> Column:
    """Plain mean of the factors that apply, cut to two decimals.

    Needs ``action_type``, ``is_numeric``, ``severity`` and the unrounded share ``__share``.
    """
    share, kind = F.col("__share"), F.col("action_type")
    size_of_nulls = F.when(share < 5, 0.95).when(share < 15, 0.80).when(share < 30, 0.60).otherwise(0.40)
    null_method = (
        F.when(F.col("is_numeric") & method.isin("FILL_MEAN", "FILL_MEDIAN"), 0.85)
        .when((method == "DELETE_ROWS") & (share > 20), 0.50)
        .otherwise(0.70)
    )
    size_of_duplicates = F.when(share < 10, 0.95).when(share < 30, 0.75).otherwise(0.60)
    outlier_method = (
        F.when(method == "CAP_OUTLIERS", 0.75).when(method == "REMOVE_OUTLIERS", 0.65).otherwise(0.70)
    )
    known = learned
    if preferred:
        boosted = F.least(F.lit(1.0), learned + F.lit(0.15))
        known = F.when(method.isin(*preferred), boosted).otherwise(learned)
    grade = (
        F.when(F.col("severity") == "LOW", 0.90).when(F.col("severity") == "HIGH", 0.50).otherwise(0.70)
    )
    mean = (
        F.when(kind == HANDLE_NULLS, (size_of_nulls + null_method + known + grade) / 4.0)
        .when(kind == REMOVE_DUPLICATES, (size_of_duplicates + known + grade) / 3.0)
        .otherwise((outlier_method + known + grade) / 3.0)
    )
    return round_cents(mean)


def risk_level(sure: Column, grade: Column) -> Column:
    return (
        F.when((sure >= 0.90) & (grade == "LOW"), "LOW")
        .when((sure >= 0.75) & grade.isin("LOW", "MEDIUM"), "MEDIUM")
        .otherwise("HIGH")
    )


def approval_status() -> Column:
    """AUTO_EXECUTED, NEEDS_APPROVAL or AUTO_APPROVED (small LOW repairs)."""
    pending_review = F.col("severity").isin("HIGH", "MEDIUM") | (F.col("__share") > 10.0)
    return (
        F.when(F.col("disposition") == "AUTO", "AUTO_EXECUTED")
        .when(pending_review, "NEEDS_APPROVAL")
        .otherwise("AUTO_APPROVED")
    )


def _reasoning() -> list[Column]:
    """Thoughts, alternatives and risks behind a proposal, as three arrays of text."""
    share, kind, n = F.col("__share"), F.col("action_type"), F.col("affected_rows")
    nulls, copies = kind == HANDLE_NULLS, kind == REMOVE_DUPLICATES
    numeric = nulls & F.col("is_numeric")
    symmetric = F.abs(F.col("mean_value") - F.col("median_value")) < F.col("std_value") * 0.1
    thoughts = F.array_compact(
        F.array(
            F.when(
                nulls,
                F.format_string("'%s' lacks a value in %.1f%% of the rows (%d)", "column_name", share, n),
            ),
            F.when(
                numeric,
                F.format_string(
                    "Holds numbers with mean %.2f and median %.2f", "mean_value", "median_value"
                ),
            ),
            F.when(
                numeric,
                F.when(symmetric, "Mean and median agree, so the values look symmetric").otherwise(
                    "Mean and median differ, so the values look skewed and the median is safer"
                ),
            ),
            F.when(nulls & (share < 5), "Few gaps: filling them changes little and keeps all rows"),
            F.when(
                nulls & (share > 30),
                "Many gaps: ask whether the column is worth keeping",
            ),
            F.when(copies, F.format_string("%d rows repeat an earlier one (%.1f%% of the table)", n, share)),
            F.when(copies, "Repeated rows weigh too much in every total"),
        )
    )
    median = nulls & (F.col("recommended_method") == "FILL_MEDIAN")
    alternatives = F.array_compact(
        F.array(
            F.when(median, "FILL_MEAN (for symmetric values)"),
            F.when(median, "DELETE_ROWS (if the gaps follow a pattern)"),
            F.when(copies, "KEEP_LAST (if later rows are corrections)"),
            F.when(copies, "Review by hand (if rows may repeat on purpose)"),
        )
    )
    deleting = nulls & (F.col("recommended_method") == "DELETE_ROWS")
    risks = F.array_compact(
        F.array(
            F.when(
                nulls & (share > 20),
                F.format_string("%.1f%% of the column would be invented values", share),
            ),
            F.when(deleting, F.format_string("%d rows would go", n)),
            F.when(copies & (share > 20), "Rows that are rightly equal would go as well"),
        )
    )
    return [thoughts.alias("thoughts"), alternatives.alias("alternatives"), risks.alias("risks")]


def propose_actions(
    issues: DataFrame,
    statistics: DataFrame,
    learning_confidence: float | Column = DEFAULT_LEARNING_CONFIDENCE,
    preferred_methods: Sequence[str] = (),
    numeric: Sequence[str] = (),
) -> DataFrame:
    """One row per proposed repair; estimated issues and LOW outliers give none.

    ``numeric`` names the numeric columns. ``issues`` and ``statistics`` have at most a few
    rows per table column, so their join is tiny whatever the size of the table.
    """
    learned = (
        learning_confidence
        if isinstance(learning_confidence, Column)
        else F.lit(float(learning_confidence))
    )
    rank = F.array_position(F.array(*[F.lit(t) for t in EXECUTION_ORDER]), F.col("action_type"))
    proposed = (
        issues.withColumn("action_type", _action_type())
        .where("action_type is not null")
        .join(statistics, "column_name", "left")
        .withColumn("is_numeric", F.coalesce(F.col("column_name").isin(*numeric), F.lit(False)))
        .withColumn("__share", percent(F.col("affected_rows"), F.col("total_rows")))
        .withColumn("recommended_method", _recommended())
        .withColumn("confidence", confidence(F.col("recommended_method"), learned, preferred_methods))
        .withColumn("risk_level", risk_level(F.col("confidence"), F.col("severity")))
        .withColumn(
            "disposition",
            F.when((F.col("confidence") >= 0.90) & (F.col("risk_level") == "LOW"), "AUTO").otherwise(
                "PENDING"
            ),
        )
    )
    return proposed.select(
        F.concat_ws(":", "action_type", F.coalesce("column_name", F.lit("*"))).alias("action_id"),
        "action_type",
        "column_name",
        "affected_rows",
        "total_rows",
        "percentage",
        "severity",
        "is_numeric",
        "recommended_method",
        _options().alias("options"),
        "confidence",
        "risk_level",
        "disposition",
        approval_status().alias("approval_status"),
        rank.cast("int").alias("execution_rank"),
        F.format_string("Affects %d records (%.1f%%)", "affected_rows", "__share").alias("impact"),
        *_reasoning(),
    )


def local_copy(df: DataFrame) -> DataFrame:
    """A result of a few rows per column (issues, statistics, a report), computed once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def plan_for(
    df: DataFrame,
    issues: DataFrame,
    learning_confidence: float | Column = DEFAULT_LEARNING_CONFIDENCE,
    preferred_methods: Sequence[str] = (),
    direct_rows: int = DIRECT_ROWS,
    facts: Facts | None = None,
) -> DataFrame:
    """Proposed repairs of a table with the given issues.

    ``facts`` of the table save reading its statistics.

    Computes the issues once, and statistics only for numeric columns that miss values.
    Both are local afterwards, so the plan can be read again without scanning the table.
    """
    rows = issues.collect()
    missing = {r["column_name"] for r in rows if r["issue_type"] == NULL_VALUES}
    numeric = [c for c in numeric_columns(df) if c in missing]
    if facts is None:
        statistics = local_copy(column_statistics(df, numeric, direct_rows=direct_rows))
    else:
        statistics = facts.statistics(df, numeric)
    kept = issues.sparkSession.createDataFrame(rows, ISSUE_SCHEMA)
    return propose_actions(kept, statistics, learning_confidence, preferred_methods, numeric_columns(df))


def plan_summary(actions: DataFrame) -> DataFrame:
    """One row: number of actions and their types. An action list has a bounded length."""
    return actions.agg(
        F.count("*").alias("action_count"),
        F.array_join(F.array_sort(F.collect_set("action_type")), ", ").alias("action_types"),
    )


def apply_decisions(actions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Join operator decisions ``(action_id, approved, method)`` to the proposals by id.

    An approved action runs the decided method, or else the recommended one.
    """
    made = decisions.select(
        "action_id", F.col("approved").alias("__approved"), F.col("method").alias("__method")
    )
    return (
        actions.join(made, "action_id", "left")
        .withColumn("method", F.coalesce("__method", "recommended_method"))
        .withColumn(
            "decision",
            F.when(F.col("__approved"), "APPROVED")
            .when(~F.col("__approved"), "REJECTED")
            .otherwise(F.col("approval_status")),
        )
        .drop("__approved", "__method")
    )


def with_steps(actions: DataFrame) -> DataFrame:
    """The plan with ``step``, the place of each action in the execution.

    A plan has a few rows per table column, so one window holds all of it.
    """
    order = Window.partitionBy(F.lit(1)).orderBy("execution_rank", F.col("column_name").asc_nulls_first())
    return actions.withColumn("step", F.row_number().over(order))


def as_actions(actions: DataFrame, method: str = "recommended_method") -> list[Action]:
    """The plan as steps in execution order; a plan has at most a few rows per column."""
    rows = actions.select(
        "action_id", "action_type", "column_name", F.col(method).alias("m"), "execution_rank"
    ).collect()
    rows.sort(key=lambda r: (r["execution_rank"], r["column_name"] or ""))
    return [Action(r["action_type"], r["m"], r["column_name"], r["action_id"]) for r in rows]
