"""Profiling: missing values, duplicate rows, outliers, severity, score and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.functions.columns import col, groupable, nan_to_null, numeric_columns, percent
from dqengine.functions.quantiles import DIRECT_ROWS, exact_quantiles, quantile_values
from dqengine.operators.duplicates import FINGERPRINT_ROWS, duplicate_count, row_copies
from dqengine.schemas import (
    DEFAULT_THRESHOLDS,
    DUPLICATES,
    DUPLICATES_ESTIMATED,
    NULL_VALUES,
    OUTLIERS,
    OUTLIERS_ESTIMATED,
    RULES,
    SAMPLED_THRESHOLDS,
    QualityRules,
    SeverityThresholds,
)


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and columns."""
    return df.agg(
        F.count("*").alias("total_records"), F.lit(len(df.columns)).cast("long").alias("total_columns")
    )


def null_sums(df: DataFrame) -> list[Column]:
    return [
        (F.count("*") - F.count(col(c))).alias(f"__null{i}") for i, c in enumerate(df.columns)
    ]


def null_counts(df: DataFrame) -> DataFrame:
    """Rows ``(column_name, affected_rows, total_rows, percentage)`` of columns with nulls."""
    df = nan_to_null(df)
    wide = df.agg(F.count("*").alias("total_rows"), *null_sums(df))
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"__null{i}").alias("affected_rows"))
        for i, c in enumerate(df.columns)
    ]
    return (
        wide.select("total_rows", F.inline(F.array(*entries)))
        .where("affected_rows > 0")
        .select(
            "column_name",
            "affected_rows",
            "total_rows",
            F.round(percent(F.col("affected_rows"), F.col("total_rows")), 2).alias("percentage"),
        )
    )


def missing_cells(df: DataFrame) -> DataFrame:
    """One row: missing cells over all columns."""
    df = nan_to_null(df)
    wide = df.agg(*null_sums(df))
    total = sum((F.col(f"__null{i}") for i in range(len(df.columns))), F.lit(0).cast("long"))
    return wide.select(F.coalesce(total, F.lit(0)).alias("missing_cells"))


def _with_moments(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """The table with the mean and deviation of every numeric column, as one subquery."""
    if not numeric:
        return df
    fields = []
    for i, c in enumerate(numeric):
        fields += [
            F.avg(col(c)).cast("double").alias(f"m{i}"),
            F.stddev_samp(col(c).cast("double")).alias(f"s{i}"),
        ]
    return df.withColumn("__z", df.agg(F.struct(*fields).alias("moments")).scalar())


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    """``|value - mean| / deviation``; NULL when the deviation is zero or undefined."""
    return F.abs(F.try_divide(value.cast("double") - mean, deviation))


def _outlier_sums(numeric: Sequence[str], threshold: float) -> list[Column]:
    """Outlier count per column, over a table from ``_with_moments``."""
    return [
        F.count_if(
            z_score(col(c), F.col(f"__z.m{i}"), F.col(f"__z.s{i}")) > threshold
        ).alias(f"__out{i}")
        for i, c in enumerate(numeric)
    ]


def outlier_counts(df: DataFrame, rules: QualityRules = RULES) -> DataFrame:
    """Rows ``(column_name, affected_rows, total_rows)`` of z-score outliers, zero included."""
    df = nan_to_null(df)
    numeric = numeric_columns(df)
    wide = _with_moments(df, numeric).agg(
        F.count("*").alias("total_rows"), *_outlier_sums(numeric, rules.outlier_std_threshold)
    )
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"__out{i}").alias("affected_rows"))
        for i, c in enumerate(numeric)
    ]
    return wide.select(F.inline(F.array(*entries)), "total_rows")


def iqr_bounds(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    rules: QualityRules = RULES,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Rows ``(column_name, q1, q3, lower_bound, upper_bound)`` by interpolated quartiles."""
    df = nan_to_null(df)
    numeric = list(columns) if columns is not None else numeric_columns(df)
    spread = F.lit(rules.iqr_factor) * (F.col("q3") - F.col("q1"))
    return (
        exact_quantiles(df, numeric, [0.25, 0.75], direct_rows=direct_rows)
        .groupBy("column_name")
        .agg(
            F.max(F.when(F.col("probability") == 0.25, F.col("value"))).alias("q1"),
            F.max(F.when(F.col("probability") == 0.75, F.col("value"))).alias("q3"),
        )
        .withColumns({"lower_bound": F.col("q1") - spread, "upper_bound": F.col("q3") + spread})
    )


def _bound_literals(
    df: DataFrame, numeric: Sequence[str], rules: QualityRules, direct_rows: int
) -> dict[str, tuple[float, float]]:
    bounds = {}
    for name, found in quantile_values(df, numeric, [0.25, 0.75], direct_rows).items():
        if found[0.25] is not None:
            spread = rules.iqr_factor * (found[0.75] - found[0.25])
            bounds[name] = (found[0.25] - spread, found[0.75] + spread)
    return bounds


def iqr_outlier_counts(
    df: DataFrame,
    rules: QualityRules = RULES,
    bounds_from: DataFrame | None = None,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Rows outside the IQR fences per numeric column; fences may come from a sample."""
    df = nan_to_null(df)
    numeric = numeric_columns(df)
    source = nan_to_null(bounds_from) if bounds_from is not None else df
    bounds = _bound_literals(source, numeric, rules, direct_rows)
    entries, sums = [], []
    for i, c in enumerate(numeric):
        outside = F.lit(False)
        if c in bounds:
            low, high = bounds[c]
            outside = (col(c) < F.lit(low)) | (col(c) > F.lit(high))
        sums.append(F.count_if(outside).alias(f"__out{i}"))
        entries.append(
            F.struct(F.lit(c).alias("column_name"), F.col(f"__out{i}").alias("affected_rows"))
        )
    wide = df.agg(F.count("*").alias("total_rows"), *sums)
    return wide.select(F.inline(F.array(*entries)), "total_rows")


def hash_sample(df: DataFrame, key: str | Column, fraction: float) -> DataFrame:
    """The rows whose key hashes into the given share of the md5 range.

    Repeatable for any partitioning; copies of a row share the key and stay together.
    """
    digest = F.substring(F.md5((col(key) if isinstance(key, str) else key).cast("string")), 1, 4)
    limit = min(65536, max(1, round(fraction * 65536)))
    return df if limit == 65536 else df.where(digest < F.lit(f"{limit:04x}"))


def estimated_duplicates(df: DataFrame, key: str | Column, fraction: float) -> DataFrame:
    """One row: duplicates in the hash sample, scaled to the whole table and truncated."""
    sample = hash_sample(groupable(nan_to_null(df)), key, fraction)
    per_row = (
        sample.groupBy(*[col(c) for c in sample.columns])
        .agg(F.count("*").alias("__copies"))
        .agg(
            F.coalesce(F.sum("__copies"), F.lit(0)).alias("sampled_rows"),
            F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("sampled_duplicates"),
        )
    )
    share = F.try_divide(F.col("sampled_duplicates") * 1.0, F.col("sampled_rows"))
    estimate = F.floor(F.coalesce(share, F.lit(0.0)) * F.col("total_rows"))
    return per_row.withColumn("total_rows", df.agg(F.count("*").alias("n")).scalar()).withColumn(
        "affected_rows", estimate
    )


def severity(issue_class: str, share: Column, limits: SeverityThresholds) -> Column:
    """Grade of an unrounded percentage; both limits are exclusive."""
    high = getattr(limits, f"{issue_class}_high")
    medium = getattr(limits, f"{issue_class}_medium")
    return F.when(share > high, "HIGH").when(share > medium, "MEDIUM").otherwise("LOW")


def severity_of(issue_type: Column, share: Column, limits: SeverityThresholds) -> Column:
    """Same grade when the issue type is itself a column."""
    return (
        F.when(issue_type == NULL_VALUES, severity("null", share, limits))
        .when(issue_type.startswith(DUPLICATES), severity("duplicate", share, limits))
        .otherwise(severity("outlier", share, limits))
    )


def _issue(kind: str, column: str | None, affected: Column, method: str) -> Column:
    return F.struct(
        F.lit(kind).alias("issue_type"),
        F.lit(column).cast("string").alias("column_name"),
        affected.cast("long").alias("affected_rows"),
        F.lit(method).alias("analysis_method"),
    )


def _graded(wide: DataFrame, entries: list[Column], limits: SeverityThresholds) -> DataFrame:
    share = percent(F.col("affected_rows"), F.col("total_rows"))
    return (
        wide.select("total_rows", F.inline(F.array(*entries)))
        .where("affected_rows > 0")
        .select(
            "issue_type",
            "column_name",
            "affected_rows",
            "total_rows",
            F.round(share, 2).alias("percentage"),
            severity_of(F.col("issue_type"), share, limits).alias("severity"),
            "analysis_method",
        )
    )


def find_issues(
    df: DataFrame,
    limits: SeverityThresholds = DEFAULT_THRESHOLDS,
    rules: QualityRules = RULES,
    fingerprint_rows: int = FINGERPRINT_ROWS,
) -> DataFrame:
    """Exact issues of a table, one row per defect.

    One scan computes all moments, one counts all nulls and outliers, one groups the
    rows; each yields a single row, joined by scalar subqueries rather than by a join.
    """
    df = nan_to_null(df)
    numeric = numeric_columns(df)
    duplicates = duplicate_count(df, fingerprint_rows).scalar()
    wide = _with_moments(df, numeric).agg(
        F.count("*").alias("total_rows"),
        *null_sums(df),
        *_outlier_sums(numeric, rules.outlier_std_threshold),
    ).withColumn("__dup", duplicates)
    return graded_issues(wide, df.columns, numeric, limits)


def graded_issues(
    wide: DataFrame, columns: Sequence[str], numeric: Sequence[str], limits: SeverityThresholds
) -> DataFrame:
    """Issues from one row with ``total_rows``, ``__null<i>``, ``__dup`` and ``__out<i>``."""
    entries = [_issue(NULL_VALUES, c, F.col(f"__null{i}"), "full_scan") for i, c in enumerate(columns)]
    entries.append(_issue(DUPLICATES, None, F.col("__dup"), "full_scan"))
    entries += [_issue(OUTLIERS, c, F.col(f"__out{i}"), "full_scan") for i, c in enumerate(numeric)]
    return _graded(wide, entries, limits)


def find_issues_sampled(
    df: DataFrame,
    key: str | Column,
    fraction: float,
    limits: SeverityThresholds = SAMPLED_THRESHOLDS,
    rules: QualityRules = RULES,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Issues with sampled duplicates and sampled IQR fences; null counts stay exact."""
    df = nan_to_null(df)
    numeric = numeric_columns(df)
    bounds = _bound_literals(hash_sample(df, key, fraction), numeric, rules, direct_rows)
    duplicates = estimated_duplicates(df, key, fraction).select("affected_rows").scalar()
    outlier_sums = [
        F.count_if((col(c) < F.lit(low)) | (col(c) > F.lit(high))).alias(f"__out_{c}")
        for c, (low, high) in bounds.items()
    ]
    wide = df.agg(F.count("*").alias("total_rows"), *null_sums(df), *outlier_sums).withColumn(
        "__dup", duplicates
    )
    entries = [
        _issue(NULL_VALUES, c, F.col(f"__null{i}"), "selective_rows")
        for i, c in enumerate(df.columns)
    ]
    entries.append(_issue(DUPLICATES_ESTIMATED, None, F.col("__dup"), "sampled_estimation"))
    entries += [
        _issue(OUTLIERS_ESTIMATED, c, col(f"__out_{c}"), "statistical_estimation") for c in bounds
    ]
    return _graded(wide, entries, limits)


def profile(
    df: DataFrame,
    mode: str = "exact",
    key: str | Column | None = None,
    fraction: float = 0.1,
    limits: SeverityThresholds | None = None,
    rules: QualityRules = RULES,
) -> DataFrame:
    """Issues by the mode that is asked for; the size of the table never decides.

    ``exact`` reads all rows for everything; ``sampled`` estimates duplicates and outliers from a sample of the
    rows, ``fraction`` of them by the hash of ``key`` (by default of the whole row).
    """
    if mode == "exact":
        return find_issues(df, limits or DEFAULT_THRESHOLDS, rules)
    if mode != "sampled":
        raise ValueError(f"unknown mode: {mode}")
    if key is None:
        key = F.xxhash64(*[col(c) for c in groupable(df).columns])
    return find_issues_sampled(df, key, fraction, limits or SAMPLED_THRESHOLDS, rules)


def quality_score(issues: DataFrame) -> DataFrame:
    """One row: ``max(0, 100 - affected / rows * 100)``; 100 without issues."""
    share = percent(F.sum("affected_rows"), F.max("total_rows"))
    return issues.agg(F.greatest(F.lit(0.0), 100.0 - F.coalesce(share, F.lit(0.0))).alias("quality_score"))


def recalculated_score(
    df: DataFrame, rules: QualityRules = RULES, fingerprint_rows: int = FINGERPRINT_ROWS
) -> DataFrame:
    """One row: rows, missing cells, duplicates, z-score outliers and the score from them."""
    df = nan_to_null(df)
    numeric = numeric_columns(df)
    zero = F.lit(0).cast("long")
    wide = _with_moments(df, numeric).agg(
        F.count("*").alias("total_rows"),
        *null_sums(df),
        *_outlier_sums(numeric, rules.outlier_std_threshold),
    )
    nulls = sum((F.col(f"__null{i}") for i in range(len(df.columns))), zero)
    outliers = sum((F.col(f"__out{i}") for i in range(len(numeric))), zero)
    counted = wide.select(
        "total_rows",
        nulls.alias("missing_cells"),
        duplicate_count(df, fingerprint_rows).scalar().alias("duplicates"),
        outliers.alias("outliers"),
    )
    total = F.col("missing_cells") + F.col("duplicates") + F.col("outliers")
    share = F.coalesce(percent(total, F.col("total_rows")), F.lit(0.0))
    return counted.withColumn("quality_score", F.greatest(F.lit(0.0), 100.0 - share))


def quality_report(df: DataFrame, name: str, issues: DataFrame, rows: int | None = None) -> DataFrame:
    """One-row report of a profiled table; its rows are counted unless ``rows`` tells."""
    size = shape(df)
    if rows is not None:
        size = df.sparkSession.createDataFrame([(rows, len(df.columns))], "total_records bigint, total_columns bigint")
    worst = issues.agg(
        F.struct(
            F.count("*").alias("n"),
            F.count_if(F.col("severity") == "HIGH").alias("high"),
            F.greatest(
                F.lit(0.0),
                100.0
                - F.coalesce(percent(F.sum("affected_rows"), F.max("total_rows")), F.lit(0.0)),
            ).alias("score"),
        ).alias("s")
    ).scalar()
    return (
        size.withColumn("__s", worst)
        .select(
            F.lit(name).alias("dataset_name"),
            "total_records",
            "total_columns",
            F.col("__s.n").alias("issue_count"),
            F.col("__s.high").alias("high_issue_count"),
            F.col("__s.score").alias("quality_score"),
            (F.col("__s.n") > 0).alias("needs_attention"),
        )
    )


def problem_rows(
    df: DataFrame,
    rules: QualityRules = RULES,
    min_values: int = 0,
    direct_rows: int = DIRECT_ROWS,
    fingerprint_rows: int = FINGERPRINT_ROWS,
) -> DataFrame:
    """Distinct rows that need attention, their reasons and how many table rows they stand for.

    Equal rows are combined before the shuffle, so a table full of copies of one row is
    no hot spot. The first copy of a row is a problem only for its other reasons; every
    further copy is a problem as a duplicate. A caller may leave columns with at most
    ``min_values`` values out of the outlier check.
    """
    df = groupable(nan_to_null(df))
    numeric = numeric_columns(df)
    filled = df.agg(*[F.count(col(c)).alias(f"v{i}") for i, c in enumerate(numeric)]).first()
    checked = [c for i, c in enumerate(numeric) if filled[i] > min_values]
    reasons = [F.when(F.array_contains(F.array(*[col(c).isNull() for c in df.columns]), True), "NULL")]
    for c, (low, high) in _bound_literals(df, checked, rules, direct_rows).items():
        reasons.append(F.when((col(c) < F.lit(low)) | (col(c) > F.lit(high)), f"OUTLIER:{c}"))
    reasons.append(F.when(F.col("copies") > 1, "DUPLICATE"))
    first_is_problem = F.size(F.filter(F.col("reasons"), lambda r: r != "DUPLICATE")) > 0
    return (
        row_copies(df, fingerprint_rows)
        .withColumn("reasons", F.array_compact(F.array(*reasons)))
        .where(F.size("reasons") > 0)
        .withColumn(
            "problem_rows", F.when(first_is_problem, F.col("copies")).otherwise(F.col("copies") - 1)
        )
    )


def null_columns_in(rows: DataFrame, full: DataFrame) -> DataFrame:
    """Null counts over the full table, only for columns with a null in ``rows``."""
    names = full.columns
    seen = rows.agg(*[F.count_if(col(c).isNull()).alias(f"__null{i}") for i, c in enumerate(names)])
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"__null{i}").alias("problem_nulls"))
        for i, c in enumerate(names)
    ]
    present = seen.select(F.inline(F.array(*entries))).where("problem_nulls > 0").select("column_name")
    return null_counts(full).join(present, "column_name", "left_semi")


def recommendations(issues: DataFrame) -> DataFrame:
    """Issues with a sentence of advice by type and severity."""
    n, c = F.col("affected_rows").cast("string"), F.col("column_name")
    share = F.concat(F.lit(" ("), F.col("percentage").cast("string"), F.lit("%)"))
    kind, high = F.col("issue_type"), F.col("severity") == "HIGH"
    # These texts are results.
    text = (
        F.when(
            (kind == NULL_VALUES) & high,
            F.concat(F.lit("Critical: Fill or remove "), n, F.lit(" null values in "), c, share),
        )
        .when(
            kind == NULL_VALUES,
            F.concat(F.lit("Consider filling "), n, F.lit(" null values in "), c),
        )
        .when(
            kind.contains(DUPLICATES) & high,
            F.concat(F.lit("Critical: Remove "), n, F.lit(" duplicate rows"), share),
        )
        .when(
            kind.contains(DUPLICATES),
            F.concat(F.lit("Review "), n, F.lit(" potential duplicate rows")),
        )
        .otherwise(F.concat(F.lit("Review "), n, F.lit(" outlier values in "), c, share))
    )
    return issues.withColumn("recommendation", text)


def severity_breakdown(issues: DataFrame) -> DataFrame:
    """One row: number of HIGH, MEDIUM and LOW issues."""
    return issues.agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("HIGH", "MEDIUM", "LOW")]
    )


def score_tier(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 70, "Good").otherwise("Needs Healing")


def score_colour(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 60, "amber").otherwise("red")


def gauge_step(score: Column) -> Column:
    """Step 1, 2 or 3 of the gauge, cut at 50 and 80."""
    return F.when(score >= 80, 3).when(score >= 50, 2).otherwise(1)


def issue_chart(issues: DataFrame) -> DataFrame:
    """Affected rows by type and severity, with subtotals and a total as NULL groups."""
    return issues.rollup("issue_type", "severity").agg(F.sum("affected_rows").alias("affected_rows"))


def top_issues(issues: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` issues that affect most rows, ties by type and column."""
    return issues.orderBy(
        F.desc("affected_rows"), "issue_type", F.col("column_name").asc_nulls_first()
    ).limit(n)
