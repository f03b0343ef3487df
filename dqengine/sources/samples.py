"""Dirty sample tables, generated by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Regions, categories and states of the samples.
SAMPLE_REGIONS = ("North", "South", "East", "West")
SALES_REGIONS = ("North", "South", "East", "West", "Central")
CATEGORIES = ("A", "B", "C", "D")
STATES = ("active", "inactive", "pending")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def sales_sample(spark: SparkSession) -> DataFrame:
    """The deterministic 500-row sales sample, whose first ten rows are repeated."""
    i = F.col("id")
    price = F.round(F.abs(i * F.lit(0.99) + 10), 2)
    rows = spark.range(500).select(
        (i + 1).alias("OrderID"),
        F.format_string("CUST_%04d", i + 1).alias("CustomerID"),
        F.format_string("PROD_%03d", i % 20).alias("ProductID"),
        F.expr("timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(cast(id as int))").alias("OrderDate"),
        F.when(i % 25 == 0, None)
        .otherwise(F.when(i % 15 == 0, 0.0).otherwise((i % 50 + 1).cast("double")))
        .alias("Quantity"),
        F.when(i % 30 != 0, price).otherwise(-price).alias("UnitPrice"),
        F.when(i % 20 == 0, None).otherwise(_pick(SAMPLE_REGIONS, i % 4)).alias("Region"),
    )
    return rows.unionByName(rows.where(F.col("OrderID") <= 10))


def sales_records(spark: SparkSession, rows: int = 10_000, seed: int = 42) -> DataFrame:
    """Random sales: 5% null and 2% zero quantities, 1% negative prices, 3% null regions."""

    def dice(k: int) -> Column:
        return F.rand(seed + k)

    def whole(k: int, low: int, high: int) -> Column:
        return (F.floor(dice(k) * (high - low + 1)) + low).cast("int")

    i = F.col("id")
    days = F.datediff(F.lit("2025-09-15"), F.lit("2024-01-01"))
    order_date = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(dice(1) * (days + 1)).cast("int"))
    price = F.round(dice(2) * 490 + 10, 2)
    return spark.range(rows).select(
        F.format_string("ORD-%06d", i + 1).alias("OrderID"),
        F.format_string("CUST-%04d", whole(3, 1, 1000)).alias("CustomerID"),
        F.format_string("PROD-%03d", whole(4, 1, 50)).alias("ProductID"),
        F.date_format(order_date, "yyyy-MM-dd").alias("OrderDate"),
        F.when(dice(5) >= 0.05, F.when(dice(6) < 0.02, 0).otherwise(whole(7, 1, 100))).alias("Quantity"),
        F.when(dice(8) < 0.01, -price).otherwise(price).alias("UnitPrice"),
        F.when(dice(9) >= 0.03, _pick(SALES_REGIONS, whole(10, 0, 4))).alias("Region"),
        F.format_string("Rep-%02d", whole(11, 1, 20)).alias("SalesRep"),
        F.concat(F.lit("Company "), F.char((i % 26 + 65).cast("int"))).alias("Customer"),
    )


def performance_records(spark: SparkSession, rows: int = 200_000, seed: int = 42) -> DataFrame:
    """Seven columns with about 2% nulls, 1% extreme incomes and 1% repeated rows."""

    def dice(k: int) -> Column:
        return F.rand(seed + k)

    i = F.col("id")
    hole = F.col("__hole")
    base = (
        spark.range(rows)
        .withColumn("__hole", dice(1))
        .select(
            "id",
            F.concat(F.lit("Customer_"), i.cast("string")).alias("name"),
            F.when(hole >= 0.02, F.floor(F.randn(seed + 2) * 10 + 35).cast("double")).alias("age"),
            F.when(
                hole >= 0.01,
                F.when(dice(3) < 0.005, 1_000_000.0)
                .when(dice(4) < 0.005, -50_000.0)
                .otherwise(F.randn(seed + 5) * 15_000 + 50_000),
            ).alias("income"),
            (dice(6) * 100).alias("score"),
            _pick(CATEGORIES, F.floor(dice(7) * 4)).alias("category"),
            _pick(STATES, F.floor(dice(8) * 3)).alias("status"),
            F.when(dice(9) < 0.01, 2).otherwise(1).alias("__copies"),
        )
    )
    return base.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop(
        "__copies", "__copy"
    )
