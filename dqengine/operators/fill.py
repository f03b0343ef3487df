"""Forward and backward fill along an order, without one window over a hot key or a whole table."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqengine.functions.columns import col, groupable
from dqengine.session import materialize

ROWS_PER_CHUNK = 1_000_000
#: Spark's ranges of a large table hold this many rows at least: each costs the driver a task's result and a sample.
ROWS_PER_RANGE = 100_000
#: Smaller ranges than that, for all tasks to have some, are made up to this number.
SMALL_RANGES = 32


def fill_along(
    df: DataFrame,
    column: str,
    order_by: Sequence[str],
    keys: Sequence[str] = (),
    forward: bool = True,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Replace a missing value by the nearest earlier (or later) one of the same key.

    Rows that ``order_by`` leaves equal follow each other by their other columns; nulls come
    first. If a key has more than ``rows_per_chunk`` rows the table is dealt out in ranges of
    that whole order, so that many rows with one order value are split as well. Each (key,
    range) is filled on its own, and one carried value per (key, range) bridges the cuts. The
    result is that of one window per key.
    """
    keys, order_by = list(keys), list(order_by)
    value = col(column)
    rest = [c for c in groupable(df).columns if c not in order_by and c not in keys]
    total_order = [*order_by, *rest]
    ordering = [col(c).asc_nulls_first() for c in total_order]

    def nearest(window: Window, source: Column) -> Column:
        if forward:
            return F.last(source, ignorenulls=True).over(
                window.rowsBetween(Window.unboundedPreceding, 0)
            )
        return F.first(source, ignorenulls=True).over(
            window.rowsBetween(0, Window.unboundedFollowing)
        )

    sizes = df.groupBy(*[col(c) for c in keys]).agg(F.count("*").alias("n"))
    size = sizes.agg(F.sum("n").alias("rows"), F.max("n").alias("largest")).first()
    if (size["largest"] or 0) <= rows_per_chunk:
        window = Window.partitionBy(*[col(c) for c in keys]).orderBy(*ordering)
        return df.withColumn(column, nearest(window, value))

    most = max(math.ceil(size["rows"] / ROWS_PER_RANGE), SMALL_RANGES)
    ranges = df.repartitionByRange(min(math.ceil(size["rows"] / rows_per_chunk), most), *ordering)
    # A row's id holds its range and its place there, so ids ascend in the whole order.
    chunk = F.expr(f"monotonically_increasing_id() div {rows_per_chunk}")
    # Written once, so that every later step sees the same cuts.
    chunked = materialize(ranges.sortWithinPartitions(*ordering).withColumn("__chunk", chunk), "ranges")
    window = Window.partitionBy(*[col(c) for c in keys], "__chunk").orderBy(*ordering)
    local = chunked.withColumn("__filled", nearest(window, value))

    order = F.when(value.isNotNull(), F.struct(*[col(c).alias(f"o{i}") for i, c in enumerate(total_order)]))
    pick = F.max_by if forward else F.min_by
    edge = chunked.groupBy(
        *[col(c).alias(f"__key{i}") for i, c in enumerate(keys)], F.col("__chunk").alias("__at")
    ).agg(pick(value, order).alias("__edge"))
    # Backward the cuts are passed in descending order: a frame up to the end would be read anew for every cut.
    at = F.col("__at").asc() if forward else F.col("__at").desc()
    across = Window.partitionBy(*[f"__key{i}" for i in range(len(keys))]).orderBy(at)
    carried = F.last("__edge", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    carry = edge.withColumn("__carry", carried).drop("__edge")
    same = [col(c).eqNullSafe(F.col(f"__key{i}")) for i, c in enumerate(keys)]
    joined = local.join(carry, reduce(lambda a, b: a & b, [F.col("__chunk") == F.col("__at"), *same]), "left")
    return joined.select(
        *[
            F.coalesce(F.col("__filled"), F.col("__carry")).alias(column) if c == column else col(c)
            for c in df.columns
        ]
    )
