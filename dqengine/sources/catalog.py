"""Tables of a database or of the catalog."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def import_table(spark: SparkSession, table: str, schema: str | None = None) -> DataFrame:
    """A whole catalog table."""
    return spark.table(f"{schema}.{table}" if schema else table)


def cut_query(table: str, column: str, partitions: int) -> str:
    """SQL for the database: the smallest key of each of ``partitions`` parts with equally many rows.

    Only standard SQL is used. Keys that many rows share give fewer different cuts, never uneven reads by guess.
    """
    parts = f"select {column} as k, ntile({partitions}) over (order by {column}) as part from {table} where {column} is not null"
    return f"select part, min(k) as k from ({parts}) cuts group by part"


def _literal(value: object) -> str:
    """A value in SQL; dates and times as text, which databases bring to the type of the column."""
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
        return "'" + str(value).replace("'", "''") + "'"
    return str(value)


def range_predicates(column: str, cuts: Sequence[object]) -> list[str]:
    """One condition per part: between two cuts, with open ends, and rows without a key in the first part.

    Every row meets exactly one condition, whatever the cuts are.
    """
    inner = sorted(set(cuts))[1:]
    if not inner:
        return ["1 = 1"]
    bounds = [_literal(c) for c in inner]
    first = f"({column} < {bounds[0]} or {column} is null)"
    between = [f"{column} >= {low} and {column} < {high}" for low, high in zip(bounds, bounds[1:])]
    return [first, *between, f"{column} >= {bounds[-1]}"]


def import_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    partitions: int | None = None,
    one_task: bool = False,
    **options: str,
) -> DataFrame:
    """A whole database table, read in parallel.

    The database itself tells where ``partition_column`` (any type that can be ordered) has to be cut for parts of
    equally many rows; each part is one task. Reading a table through a single task has to be asked for by
    ``one_task``, since it does not grow.
    """
    if one_task:
        return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    if partition_column is None:
        raise ValueError("name a partition column, or ask for one task")
    partitions = partitions or spark.sparkContext.defaultParallelism
    cuts = spark.read.format("jdbc").options(url=url, query=cut_query(table, partition_column, partitions), **options)
    found = [row["k"] for row in cuts.load().select("k").collect()]
    return spark.read.jdbc(url, table, predicates=range_predicates(partition_column, found), properties=dict(options))


def import_registration(df: DataFrame, schema: str, table: str, stamp: str, name: str | None = None) -> DataFrame:
    """One registry row of an imported table: name, PENDING and its number of rows."""
    return df.agg(F.count("*").alias("processed_rows")).select(
        F.lit(name or f"{schema}_{table}_import_{stamp}").alias("dataset_name"),
        F.lit("PENDING").alias("status"),
        "processed_rows",
    )


def table_row_counts(spark: SparkSession, tables: Sequence[str], schema: str = "default") -> DataFrame:
    """Name and number of rows of each table, in one job."""
    counts = [
        spark.table(t).agg(F.count("*").alias("row_count")).select(
            F.lit(schema).alias("schema_name"), F.lit(t).alias("table_name"), "row_count"
        )
        for t in tables
    ]
    return reduce(DataFrame.unionAll, counts).orderBy("schema_name", "table_name")


def catalog_row_counts(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """Row counts of all tables of a catalog schema."""
    listed = [t.name for t in spark.catalog.listTables(schema)]
    if not listed:
        return spark.createDataFrame([], "schema_name string, table_name string, row_count bigint")
    return table_row_counts(spark, listed, schema or spark.catalog.currentDatabase())


def catalogue_totals(schemas: DataFrame, tables: DataFrame, partitions: DataFrame) -> DataFrame:
    """Rows per table from ``(schema_id, schema_name)``, ``(table_id, table_name, schema_id)``
    and ``(table_id, rows)``; partitions are summed before they are joined.
    """
    totals = partitions.groupBy("table_id").agg(F.sum("rows").alias("row_count"))
    return (
        tables.join(schemas, "schema_id")
        .join(totals, "table_id")
        .select("schema_name", "table_name", "row_count")
        .orderBy("schema_name", "table_name")
    )
