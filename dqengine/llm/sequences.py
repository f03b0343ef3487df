"""Places, running sums and list ranks over sequences of any length, without a task for a whole group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqengine.llm.common import ship
from dqengine.session import materialize

#: Rows of a sequence that one window holds.
CHUNK_BITS = 13
#: Elements of a list that one task walks.
BLOCK_BITS = 14


def placed(rows: DataFrame, groups: list[str], order: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """The rows with ``part`` and ``seq``, and for each part and group its ``first`` seq, ``n`` rows and rows ``before``.

    A row's place in its group, from 0, is ``seq - first + before``. All rows are sorted by range, groups and order
    together, so a hot group is spread over many tasks; rows that are equal in both are dealt out at random. The
    sorted rows are written once, which fixes ``part`` and ``seq``.
    """
    keys = [*groups, *order, "tie"]
    ordered = rows.withColumn("tie", F.rand(17)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    table = materialize(
        ordered.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), label
    )
    parts = table.groupBy("part", *groups).agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return table, parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def with_parts(table: DataFrame, parts: DataFrame, groups: list[str]) -> DataFrame:
    """The rows of ``placed`` with the columns of their part and group, and their ``place``; null groups are one."""
    keys = ["part", *groups]
    other = parts.withColumnsRenamed({k: f"{k}_" for k in keys})
    equal = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return table.join(other, equal).withColumn("place", F.col("seq") - F.col("first") + F.col("before"))


def numbered(rows: DataFrame, groups: list[str], order: list[str], label: str) -> DataFrame:
    """The rows with their ``place`` in their group, from 0."""
    return with_parts(*placed(rows, groups, order, label), groups).select(*rows.columns, "place")


def running(rows: DataFrame, place: str, values: list[str]) -> DataFrame:
    """The rows with, for each value, the sum ``<value>_upto`` over all places up to and with their own.

    Places count from 0. Each chunk of places is summed by itself, then the chunks are, in the same way.
    """
    chunk = F.shiftright(place, CHUNK_BITS)
    inner = Window.partitionBy("chunk").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("chunk", chunk)
    sums = rows.groupBy("chunk").agg(*[F.sum(v).alias(v) for v in values])
    sums = materialize(sums, "chunk-sums")
    if sums.count() > 1 << CHUNK_BITS:
        upto = running(sums.withColumnRenamed("chunk", "number"), "number", values).withColumnRenamed("number", "chunk")
    else:
        all_chunks = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = sums.select("*", *[F.sum(v).over(all_chunks).alias(f"{v}_upto") for v in values])
    before = upto.select("chunk", *[(F.col(f"{v}_upto") - F.col(v)).alias(f"{v}_before") for v in values])
    local = rows.select("*", *[F.sum(v).over(inner).alias(f"{v}_upto") for v in values])
    return (
        local.join(before, "chunk")
        .withColumns({f"{v}_upto": F.col(f"{v}_upto") + F.col(f"{v}_before") for v in values})
        .drop("chunk", *[f"{v}_before" for v in values])
    )


def list_ranks(links: DataFrame, head: int, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``item`` and ``rank``, its distance to the end, for a linked list of ``item``, ``next`` (-1: end) and ``hops``.

    Each task walks the links inside its block of items by pointer jumping and ends at the first item of another
    block. Only items that such a walk ends at, and the head, form the next, shorter list; its ranks give those of all
    items. A list that blocks do not halve is ranked by jumps over the whole list instead: after every round of joins
    each pointer reaches twice as far. Every list is written before it is used.
    """
    ship(links.sparkSession)
    shift, n = block_bits, links.count()
    levels = []
    while True:
        local = links.groupBy(F.shiftright("item", shift).alias("block"))
        walked = materialize(local.applyInArrow(_walk, "item long, next long, hops long"), "walked")
        blocks = links.select(F.shiftright("item", shift)).distinct().limit(2).count()
        if blocks < 2:
            ranks = walked.select("item", F.col("hops").alias("rank"))
            break
        levels.append(walked)
        entered = walked.filter("next >= 0").select(F.col("next").alias("item"))
        entered = entered.union(entered.sparkSession.range(head, head + 1).toDF("item")).distinct()
        links = materialize(walked.join(entered, "item", "left_semi"), "entered")
        left = links.count()
        if left > n // 2:
            ranks = _jump(links)
            break
        shift, n = shift + (n // max(left, 1)).bit_length() - 1, left
    for walked in reversed(levels):
        known = ranks.select(F.col("item").alias("next"), "rank")
        whole = F.col("hops") + F.coalesce(F.col("rank"), F.lit(0))
        ranks = walked.join(known, "next", "left").select("item", whole.alias("rank"))
    return ranks


def _jump(links: DataFrame) -> DataFrame:
    """Ranks by pointer jumping over the whole list."""
    while links.filter("next >= 0").limit(1).count():
        onward = links.select(F.col("item").alias("next"), F.col("next").alias("after"), F.col("hops").alias("more"))
        further = links.filter("next >= 0").join(onward, "next").selectExpr("item", "after as next", "hops + more as hops")
        links = materialize(further.union(links.filter("next < 0").select("item", "next", "hops")), "jumped")
    return links.select("item", F.col("hops").alias("rank"))


def _walk(table: pa.Table) -> pa.Table:
    """For each item of a block, the first item outside it that its links reach, and the hops to there."""
    item, onward, hops = (table.column(c).to_numpy() for c in ("item", "next", "hops"))
    order = np.argsort(item)
    item, onward, hops = item[order], onward[order].copy(), hops[order].copy()
    while True:
        at = np.minimum(np.searchsorted(item, onward), len(item) - 1)
        inside = np.flatnonzero(item[at] == onward)
        if not len(inside):
            return pa.table({"item": item, "next": onward, "hops": hops})
        to = at[inside]
        hops[inside], onward[inside] = hops[inside] + hops[to], onward[to]
