"""Stored datasets and exports."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqengine.schemas import DATASET_SCHEMA
from dqengine.sources.feeds import stringify_complex


def store_dataset(
    df: DataFrame,
    name: str,
    root: str,
    processed_at: datetime,
    processed: DataFrame | None = None,
    quality_score: float = 0.0,
    dataset_id: str | None = None,
    status: str = "PROCESSING",
) -> str:
    """Write a version of a dataset and append its registry row; returns the dataset id.

    Versions are never overwritten; the registry's latest row per id is the current one.
    """
    spark = df.sparkSession
    dataset_id = dataset_id or uuid.uuid4().hex
    version = uuid.uuid4().hex
    base = f"{root}/datasets/dataset_id={dataset_id}/version={version}"
    df.write.parquet(f"{base}/original")
    if processed is not None:
        processed.write.parquet(f"{base}/processed")
    rows = spark.read.parquet(f"{base}/original").count()
    row = (
        dataset_id,
        name,
        version,
        f"{base}/original",
        f"{base}/processed" if processed is not None else None,
        float(quality_score),
        status,
        rows,
        processed_at,
    )
    spark.createDataFrame([row], DATASET_SCHEMA).write.mode("append").parquet(f"{root}/registry")
    return dataset_id


def registry(spark: SparkSession, root: str) -> DataFrame:
    """Current registry row of every dataset."""
    rows = spark.read.parquet(f"{root}/registry")
    whole = F.struct(*[c for c in rows.columns])
    order = F.struct("processed_at", "version")
    return (
        rows.groupBy(F.col("dataset_id").alias("__id"))
        .agg(F.max_by(whole, order).alias("__row"))
        .select("__row.*")
    )


def _path(spark: SparkSession, root: str, dataset_id: str, column: str) -> str | None:
    found = registry(spark, root).where(F.col("dataset_id") == dataset_id).select(column).first()
    return found[0] if found else None


def original_data(spark: SparkSession, root: str, dataset_id: str) -> DataFrame | None:
    path = _path(spark, root, dataset_id, "original_path")
    return spark.read.parquet(path) if path else None


def processed_data(spark: SparkSession, root: str, dataset_id: str) -> DataFrame | None:
    path = _path(spark, root, dataset_id, "processed_path")
    return spark.read.parquet(path) if path else None


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write as CSV with a header, or as JSON lines; nested cells become text in CSV."""
    if fmt == "csv":
        stringify_complex(df).write.options(
            header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false"
        ).csv(path)
    elif fmt == "json":
        df.write.option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"Unsupported export format: {fmt}")


def export_with_report(df: DataFrame, report: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the data and its validation report side by side."""
    export(df, f"{path}/data", fmt)
    export(report, f"{path}/validation_report", fmt)
