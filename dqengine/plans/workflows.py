"""Whole repairs: profile, plan, apply, prove."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqengine.functions.columns import nan_to_null, percent
from dqengine.operators.facts import table_facts
from dqengine.operators.heal import Healed, heal
from dqengine.operators.profile import quality_report, recalculated_score
from dqengine.plans.repair_plan import (
    DEFAULT_LEARNING_CONFIDENCE,
    apply_decisions,
    as_actions,
    local_copy,
    plan_for,
    plan_summary,
)
from dqengine.schemas import DEFAULT_THRESHOLDS, SeverityThresholds


def validation_report(before: DataFrame, after: DataFrame, actions_run: int) -> DataFrame:
    """One row comparing two one-row quality reports."""
    pick = F.struct("quality_score", "issue_count").alias("r")
    old_score, new_score = F.col("quality_score"), F.col("__new.quality_score")
    old_issues, new_issues = F.col("issue_count"), F.col("__new.issue_count")
    return before.withColumn("__new", after.select(pick).scalar()).select(
        old_score.alias("original_quality_score"),
        new_score.alias("final_quality_score"),
        (new_score - old_score).alias("quality_improvement"),
        old_issues.alias("original_issues_count"),
        new_issues.alias("final_issues_count"),
        (old_issues - new_issues).alias("issues_resolved"),
        F.lit(actions_run).cast("long").alias("healing_actions_executed"),
        F.when(new_score >= old_score, "PASSED")
        .otherwise("IMPROVEMENT_NEEDED")
        .alias("validation_status"),
    )


@dataclass
class FeedRepair:
    issues: DataFrame
    actions: DataFrame
    healed: Healed
    validation: DataFrame


def repair_feed(
    df: DataFrame, name: str, limits: SeverityThresholds = DEFAULT_THRESHOLDS, measure: bool = True
) -> FeedRepair:
    """Profile, run every recommended repair without approval, and validate the result."""
    facts = table_facts(df)
    issues = local_copy(facts.issues(df, limits))
    actions = plan_for(df, issues, facts=facts)
    steps = as_actions(actions)
    healed = heal(df, steps, measure=measure, write_end=True, known=facts)
    rest = table_facts(healed.df, shares=())
    validation = validation_report(
        quality_report(df, name, issues, facts.rows),
        quality_report(healed.df, f"HEALED_{name}", rest.issues(healed.df, limits), rest.rows),
        len(steps),
    )
    return FeedRepair(issues, actions, healed, validation)


@dataclass
class ProcessedDataset:
    issues: DataFrame
    actions: DataFrame
    healed: Healed
    status: str
    summary: DataFrame
    action_log: DataFrame


def _log(agent: str, kind: str, details: object, status: str, approval: str | None = None) -> list:
    text = F.lit(details) if isinstance(details, str) else details
    return [
        F.lit(agent).alias("agent_name"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("action_type"),
        text.alias("action_details"),
        F.lit(status).alias("execution_status"),
        F.lit(approval).cast("string").alias("human_approval"),
    ]


def processing_log(
    name: str, report: DataFrame, issues: DataFrame, actions: DataFrame, executed: int, status: str
) -> DataFrame:
    """Action-log rows of one processed table: start, issues, proposals, execution, end.

    ``report`` is the one-row quality report with ``final_quality_score``; all inputs are small.
    """
    # The agents, kinds and texts of the log are results.
    share = F.format_string("%.0f%%", F.col("confidence") * 100)
    where = F.coalesce("column_name", F.lit("multiple"))
    score = F.format_string("%.1f/100", "quality_score")
    parts = [
        report.select(
            *_log(
                "PipelineOrchestrator",
                "DATASET_PROCESSING_START",
                F.format_string(
                    "Starting processing for %s (%d records, %d columns)",
                    F.lit(name),
                    "total_records",
                    "total_columns",
                ),
                "COMPLETED",
            )
        ),
        report.select(
            *_log(
                "DataQualityAgent",
                "QUALITY_ANALYSIS_COMPLETE",
                F.concat(
                    F.lit("Analysis complete - Quality Score: "),
                    score,
                    F.lit(", Issues Found: "),
                    F.col("issue_count"),
                ),
                "COMPLETED",
            )
        ),
        issues.select(
            *_log(
                "DataQualityAgent",
                F.concat(F.lit("ISSUE_DETECTED_"), F.col("issue_type")),
                F.concat(
                    F.lit("Column '"),
                    F.coalesce("column_name", F.lit("Multiple")),
                    F.format_string("': %d rows affected (", "affected_rows"),
                    F.col("percentage").cast("string"),
                    F.lit("%) - Severity: "),
                    F.col("severity"),
                ),
                "COMPLETED",
            )
        ),
        report.where("issue_count = 0").select(
            *_log(
                "DataQualityAgent",
                "NO_ISSUES_FOUND",
                "Data quality analysis completed - no significant issues detected",
                "COMPLETED",
            )
        ),
        plan_summary(actions).where("action_count > 0").select(
            *_log(
                "DataHealingAgent",
                "HEALING_PLAN_COMPLETE",
                F.concat(
                    F.lit("Generated "), "action_count", F.lit(" healing actions: "), "action_types"
                ),
                "COMPLETED",
            )
        ),
        report.where(F.lit(executed) > 0).select(
            *_log(
                "DataHealingAgent",
                "AUTO_EXECUTION_COMPLETE",
                F.format_string(
                    f"Auto-executed {executed} actions. Quality score: %.1f%% to %.1f%% (%+.1f%%)",
                    "quality_score",
                    "final_quality_score",
                    F.col("final_quality_score") - F.col("quality_score"),
                ),
                "COMPLETED",
            )
        ),
        actions.where("approval_status = 'AUTO_EXECUTED'").select(
            *_log(
                "DataHealingAgent",
                F.concat(F.lit("AUTO_EXECUTED_"), F.col("action_type")),
                F.concat(
                    F.lit("Auto-executed "), F.col("action_type"), F.lit(" (confidence: "), share,
                    F.lit(") for column '"), where, F.lit("'"),
                ),
                "COMPLETED",
                "NOT_REQUIRED",
            )
        ),
        actions.where("approval_status <> 'AUTO_EXECUTED'").select(
            *_log(
                "DataHealingAgent",
                F.concat(F.lit("HEALING_PROPOSED_"), F.col("action_type")),
                F.concat(
                    F.lit("Proposed "), F.col("action_type"), F.lit(" (confidence: "), share,
                    F.lit(") for column '"), where,
                    F.format_string("' affecting %d records", "affected_rows"),
                ),
                "PENDING_APPROVAL",
            )
        ),
        actions.where("approval_status = 'AUTO_APPROVED'").select(
            *_log(
                "PipelineOrchestrator",
                F.concat(F.lit("AUTO_APPROVED_"), F.col("action_type")),
                F.concat(
                    F.lit("Auto-approved "), F.col("severity"),
                    F.format_string(" severity action affecting %d records (", "affected_rows"),
                    F.format_string("%.1f%%", percent(F.col("affected_rows"), F.col("total_rows"))),
                    F.lit(") - below approval threshold"),
                ),
                "COMPLETED",
                "AUTO_APPROVED",
            )
        ),
        report.select(
            *_log(
                "PipelineOrchestrator",
                "DATASET_PROCESSING_COMPLETE",
                F.concat(
                    F.lit(f"Processing complete for {name} - Status: {status}, Quality Score: "), score
                ),
                "COMPLETED",
            )
        ),
    ]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return log


def process_dataset(
    df: DataFrame,
    name: str,
    learning_confidence: float = DEFAULT_LEARNING_CONFIDENCE,
    preferred_methods: tuple[str, ...] = (),
    limits: SeverityThresholds = DEFAULT_THRESHOLDS,
    execute_auto_approved: bool = False,
) -> ProcessedDataset:
    """Profile, run only the automatic repairs, and list what an operator must approve."""
    facts = table_facts(df)
    issues = local_copy(facts.issues(df, limits))
    actions = plan_for(df, issues, learning_confidence, preferred_methods, facts=facts)
    run = ["AUTO_EXECUTED", "AUTO_APPROVED"] if execute_auto_approved else ["AUTO_EXECUTED"]
    steps = as_actions(actions.where(F.col("approval_status").isin(*run)))
    healed = heal(df, steps, write_end=True, known=facts)
    waiting = not actions.where("approval_status = 'NEEDS_APPROVAL'").isEmpty()
    status = "PENDING_APPROVAL" if waiting else "COMPLETED"
    report = quality_report(df, name, issues, facts.rows).withColumns(
        {
            "status": F.lit(status),
            "final_quality_score": recalculated_score(healed.df).select("quality_score").scalar()
            if healed.entries
            else F.col("quality_score"),
        }
    )
    summary = local_copy(report)
    log = processing_log(name, summary, issues, actions, len(healed.entries), status)
    return ProcessedDataset(issues, actions, healed, status, summary, log)


def run_decisions(df: DataFrame, actions: DataFrame, decisions: DataFrame) -> Healed:
    """Run the approved repairs on the table; undecided and rejected ones stay undone."""
    approved = apply_decisions(actions, decisions).where("decision = 'APPROVED'")
    return heal(nan_to_null(df), as_actions(approved, "method"))


def decision_log(approved: DataFrame, execution: DataFrame) -> DataFrame:
    """Bulk-approval log: an approval and an execution row per success, one row per failure."""
    def entry(agent: str, kind: str, details, status: str, approval: str | None):
        return F.struct(
            F.lit(agent).alias("agent_name"),
            F.concat(F.lit(kind), F.col("action_type")).alias("action_type"),
            details.alias("action_details"),
            F.lit(status).alias("execution_status"),
            F.lit(approval).cast("string").alias("human_approval"),
        )

    good = F.array(
        entry(
            "HumanOperator",
            "APPROVED_",
            F.concat(F.lit("Bulk approved "), "action_type", F.lit(" - "), "impact"),
            "COMPLETED",
            "APPROVED",
        ),
        entry(
            "DataHealingAgent",
            "EXECUTED_",
            F.concat(
                F.lit("Bulk executed "),
                "method",
                F.format_string(" - Records affected: %d", "records_affected"),
            ),
            "COMPLETED",
            None,
        ),
    )
    bad = F.array(
        entry(
            "DataHealingAgent",
            "FAILED_",
            F.concat(F.lit("Bulk execution failed: "), "message"),
            "FAILED",
            None,
        )
    )
    joined = execution.join(approved.select("action_id", "impact"), "action_id")
    return joined.select("action_id", F.inline(F.when(F.col("success"), good).otherwise(bad)))


def completion(pending: DataFrame, executed: DataFrame, scores: DataFrame) -> DataFrame:
    """Status and display score of every dataset.

    A dataset is COMPLETED when as many actions ran as were pending; only then its final
    score replaces the initial one. All inputs carry ``dataset_id``.
    """
    waiting = pending.groupBy("dataset_id").agg(F.count("*").alias("pending_actions"))
    done = executed.groupBy("dataset_id").agg(F.count("*").alias("executed_actions"))
    complete = F.col("executed_actions") >= F.col("pending_actions")
    return (
        scores.join(waiting, "dataset_id", "left")
        .join(done, "dataset_id", "left")
        .fillna(0, ["pending_actions", "executed_actions"])
        .select(
            "dataset_id",
            "pending_actions",
            "executed_actions",
            F.when(complete, "COMPLETED").otherwise("HEALING_IN_PROGRESS").alias("status"),
            F.when(complete, F.coalesce("final_score", "initial_score"))
            .otherwise(F.col("initial_score"))
            .alias("display_score"),
        )
    )
