"""What a whole repair needs to know of a table, in few scans.

Profile, plan and repair ask for the same numbers. One scan gives moments and missing cells; one counts outliers by
those moments and sums up the quantiles of the columns that miss values; for these alone, one light scan counts the
values around the summaries' brackets, and one picks the few inside. Duplicates are one grouping.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.functions.columns import col, nan_to_null, numeric_columns
from dqengine.functions.quantiles import DIRECT_ROWS, at_brackets, bracket_counts, bracket_ends, bracket_targets, quantile_values
from dqengine.operators.duplicates import FINGERPRINT_ROWS, duplicate_count
from dqengine.operators.profile import graded_issues, null_sums, z_score
from dqengine.schemas import DEFAULT_THRESHOLDS, RULES, QualityRules, SeverityThresholds

#: Shares that the plan and the recommended fills ask for.
SHARES = (0.5,)


@dataclass(frozen=True)
class Facts:
    """Numbers of one table. ``quantiles`` is by column and share, for numeric columns that miss values."""

    rows: int
    columns: tuple[str, ...]
    numeric: tuple[str, ...]
    missing: dict[str, int]
    outliers: dict[str, int]
    duplicates: int
    means: dict[str, float | None]
    deviations: dict[str, float | None]
    quantiles: dict[str, dict[float, float | None]] = field(default_factory=dict)

    def issues(self, df: DataFrame, limits: SeverityThresholds = DEFAULT_THRESHOLDS) -> DataFrame:
        """The issues of the table, as ``find_issues`` gives them; a local table."""
        spark = df.sparkSession
        names = [f"__null{i}" for i in range(len(self.columns))] + [f"__out{i}" for i in range(len(self.numeric))]
        values = [*(self.missing[c] for c in self.columns), *(self.outliers[c] for c in self.numeric)]
        schema = T.StructType([T.StructField(n, T.LongType()) for n in ("total_rows", "__dup", *names)])
        wide = spark.createDataFrame([(self.rows, self.duplicates, *values)], schema)
        return graded_issues(wide, self.columns, self.numeric, limits)

    def statistics(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Mean, median and deviation of some columns, as ``column_statistics`` gives them; a local table."""
        rows = [(c, self.means[c], self.deviations[c], self.quantiles[c][0.5]) for c in columns]
        schema = "column_name string, mean_value double, std_value double, median_value double"
        return df.sparkSession.createDataFrame(rows, schema)

    def number(self, column: str, kind: str, share: float | None) -> tuple[bool, float | None]:
        """Whether a mean, deviation or quantile is known, and its value."""
        if kind in ("mean", "std"):
            known = self.means if kind == "mean" else self.deviations
            return column in known, known.get(column)
        found = self.quantiles.get(column, {})
        return share in found, found.get(share)


def table_facts(
    df: DataFrame,
    shares: Sequence[float] = SHARES,
    rules: QualityRules = RULES,
    fingerprint_rows: int = FINGERPRINT_ROWS,
    direct_rows: int = DIRECT_ROWS,
) -> Facts:
    """All numbers of a table: two scans and one grouping, and two light scans if ``shares`` are asked for."""
    df = nan_to_null(df)
    columns, numeric = df.columns, numeric_columns(df)
    moments = [F.avg(col(c)).cast("double").alias(f"__m{i}") for i, c in enumerate(numeric)]
    moments += [F.stddev_samp(col(c).cast("double")).alias(f"__s{i}") for i, c in enumerate(numeric)]
    first = df.agg(F.count("*").alias("rows"), *null_sums(df), *moments).first()
    missing = {c: first[f"__null{i}"] for i, c in enumerate(columns)}
    means = {c: first[f"__m{i}"] for i, c in enumerate(numeric)}
    deviations = {c: first[f"__s{i}"] for i, c in enumerate(numeric)}

    def outside(column: str):
        mean, deviation = (F.lit(x[column]).cast("double") for x in (means, deviations))
        return z_score(col(column), mean, deviation) > rules.outlier_std_threshold

    filled = [c for c in numeric if missing[c]] if shares else []
    counts = [F.count_if(outside(c)).alias(f"__out{i}") for i, c in enumerate(numeric)]
    second = df.agg(F.lit(0).alias("__none"), *counts, *bracket_ends(filled, shares)).first()
    quantiles: dict[str, dict[float, float | None]] = {}
    if filled:
        targets = bracket_targets(second, filled, shares)
        around = df.agg(*bracket_counts(filled, targets)).first()
        found = at_brackets(df, filled, targets, around, direct_rows)
        if found is None:  # a bracket missed its rank, or holds too many rows
            quantiles = quantile_values(df, filled, list(shares), direct_rows, rows=first["rows"])
        else:
            for c, share, value in found:
                quantiles.setdefault(c, {})[share] = value
    return Facts(
        first["rows"],
        tuple(columns),
        tuple(numeric),
        missing,
        {c: second[f"__out{i}"] for i, c in enumerate(numeric)},
        duplicate_count(df, fingerprint_rows, first["rows"]).first()["duplicates"],
        means,
        deviations,
        quantiles,
    )
