"""Record schemas, rule constants and severity profiles shared by every module."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Issue, action and method names, thresholds, confidence factors.
NULL_VALUES = "NULL_VALUES"
DUPLICATES = "DUPLICATES"
OUTLIERS = "OUTLIERS"
DUPLICATES_ESTIMATED = "DUPLICATES_ESTIMATED"
OUTLIERS_ESTIMATED = "OUTLIERS_ESTIMATED"

HANDLE_NULLS = "HANDLE_NULLS"
REMOVE_DUPLICATES = "REMOVE_DUPLICATES"
HANDLE_OUTLIERS = "HANDLE_OUTLIERS"
EXECUTION_ORDER = (HANDLE_NULLS, REMOVE_DUPLICATES, HANDLE_OUTLIERS)


@dataclass(frozen=True)
class QualityRules:
    """Limits of the detectors."""

    null_threshold: float = 0.05
    duplicate_threshold: float = 0.02
    outlier_std_threshold: float = 3.0
    iqr_factor: float = 1.5
    alert_score: float = 70.0


@dataclass(frozen=True)
class SeverityThresholds:
    """A percentage strictly above ``*_high`` is HIGH, above ``*_medium`` MEDIUM."""

    null_high: float = 10.0
    null_medium: float = 5.0
    duplicate_high: float = 5.0
    duplicate_medium: float = 2.0
    outlier_high: float = 5.0
    outlier_medium: float = 2.0


RULES = QualityRules()
DEFAULT_THRESHOLDS = SeverityThresholds()
SAMPLED_THRESHOLDS = SeverityThresholds(15.0, 5.0, 10.0, 2.0, 10.0, 3.0)
# The learned profile names no outlier limits, so the defaults apply there.
LEARNED_THRESHOLDS = SeverityThresholds(15.0, 8.0, 10.0, 5.0)

ISSUE_SCHEMA = T.StructType(
    [
        T.StructField("issue_type", T.StringType(), False),
        T.StructField("column_name", T.StringType(), True),
        T.StructField("affected_rows", T.LongType(), False),
        T.StructField("total_rows", T.LongType(), False),
        T.StructField("percentage", T.DoubleType(), True),
        T.StructField("severity", T.StringType(), False),
        T.StructField("analysis_method", T.StringType(), False),
    ]
)
EXECUTION_LOG_SCHEMA = T.StructType(
    [
        T.StructField("step", T.IntegerType(), False),
        T.StructField("action_id", T.StringType(), False),
        T.StructField("action_type", T.StringType(), False),
        T.StructField("column_name", T.StringType(), True),
        T.StructField("method", T.StringType(), False),
        T.StructField("rows_before", T.LongType(), True),
        T.StructField("rows_after", T.LongType(), True),
        T.StructField("records_affected", T.LongType(), True),
        T.StructField("cells_changed", T.LongType(), True),
        T.StructField("success", T.BooleanType(), False),
        T.StructField("message", T.StringType(), False),
    ]
)
DATASET_SCHEMA = T.StructType(
    [
        T.StructField("dataset_id", T.StringType(), False),
        T.StructField("dataset_name", T.StringType(), False),
        T.StructField("version", T.StringType(), False),
        T.StructField("original_path", T.StringType(), True),
        T.StructField("processed_path", T.StringType(), True),
        T.StructField("quality_score", T.DoubleType(), True),
        T.StructField("status", T.StringType(), False),
        T.StructField("processed_rows", T.LongType(), True),
        T.StructField("processed_at", T.TimestampType(), False),
    ]
)
QUALITY_ISSUE_SCHEMA = T.StructType(
    [
        T.StructField("dataset_id", T.StringType(), False),
        T.StructField("issue_type", T.StringType(), False),
        T.StructField("issue_description", T.StringType(), True),
        T.StructField("affected_rows", T.LongType(), True),
        T.StructField("severity", T.StringType(), True),
        T.StructField("detected_at", T.TimestampType(), False),
    ]
)
ACTION_LOG_SCHEMA = T.StructType(
    [
        T.StructField("dataset_id", T.StringType(), True),
        T.StructField("agent_name", T.StringType(), False),
        T.StructField("action_type", T.StringType(), False),
        T.StructField("action_details", T.StringType(), True),
        T.StructField("execution_status", T.StringType(), False),
        T.StructField("human_approval", T.StringType(), True),
        T.StructField("action_at", T.TimestampType(), False),
    ]
)
FEEDBACK_SCHEMA = T.StructType(
    [
        T.StructField("agent_name", T.StringType(), False),
        T.StructField("action_id", T.LongType(), True),
        T.StructField("feedback_type", T.StringType(), True),
        T.StructField("feedback_text", T.StringType(), True),
        T.StructField("rating", T.IntegerType(), True),
        T.StructField("context", T.StringType(), True),
        T.StructField("feedback_at", T.TimestampType(), False),
    ]
)
LEARNING_SCHEMA = T.StructType(
    [
        T.StructField("agent_name", T.StringType(), False),
        T.StructField("action_type", T.StringType(), False),
        T.StructField("context", T.StringType(), True),
        T.StructField("input_data", T.StringType(), True),
        T.StructField("output_data", T.StringType(), True),
        T.StructField("outcome", T.StringType(), False),
        T.StructField("success_score", T.DoubleType(), False),
        T.StructField("execution_time", T.DoubleType(), True),
        T.StructField("error_message", T.StringType(), True),
        T.StructField("logged_at", T.TimestampType(), False),
    ]
)
FEED_SOURCE_SCHEMA = T.StructType(
    [
        T.StructField("source_id", T.LongType(), False),
        T.StructField("source_name", T.StringType(), False),
        T.StructField("api_url", T.StringType(), True),
        T.StructField("fetch_interval", T.IntegerType(), False),
        T.StructField("is_active", T.BooleanType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)
FEED_SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("source_id", T.LongType(), True),
        T.StructField("payload", T.StringType(), True),
        T.StructField("snapshot_format", T.StringType(), False),
        T.StructField("records_count", T.LongType(), True),
        T.StructField("fetched_at", T.TimestampType(), False),
    ]
)
