"""Whole-row duplicates, without shuffling whole rows when the table is large.

Plain grouping combines copies before the shuffle but still moves every distinct row.
Above ``FINGERPRINT_ROWS`` rows a first pass groups an 8-byte fingerprint of each row.
The fingerprints that occur more than once set bits of a filter of fixed size, which is
built by a distributed aggregation and sent to all tasks. Rows outside the filter are
unique for certain and stay where they are; only the others are grouped on all their
columns, which settles hash collisions and false hits exactly. More repeated fingerprints
than the filter has bits for cost more grouping, and change no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqengine.functions.columns import col, groupable, holds_map
from dqengine.session import materialize

FINGERPRINT_ROWS = 100_000_000
#: The filter has so many maps of 32,768 bits (4 KB) each: 16 MB.
FILTER_MAPS = 4096
_MAP_BITS = 15


def row_fingerprint(df: DataFrame) -> Column:
    """64-bit row hash; the null flags keep (NULL, 'a') apart from ('a', NULL)."""
    names = df.columns
    return F.xxhash64(*[col(c) for c in names], *[col(c).isNull() for c in names])


def _place(fingerprint: str, maps: int) -> tuple[Column, Column]:
    """Map and bit of a fingerprint in the filter."""
    at = F.pmod(fingerprint, F.lit(maps << _MAP_BITS))
    return F.shiftright(at, _MAP_BITS), at.bitwiseAND(F.lit((1 << _MAP_BITS) - 1))


def repeat_filter(tagged: DataFrame, maps: int) -> DataFrame:
    """At most ``maps`` rows (``__map``, ``__bits``): the bits of all fingerprints ``__fp`` that occur twice or more."""
    repeated = tagged.groupBy("__fp").agg(F.count("*").alias("__c")).where("__c > 1")
    number, bit = _place("__fp", maps)
    return repeated.groupBy(number.alias("__map")).agg(F.bitmap_construct_agg(bit).alias("__bits"))


def _split(
    df: DataFrame, fingerprint_rows: int, rows: int | None = None
) -> tuple[DataFrame, DataFrame] | None:
    """(rows that are unique, rows that may repeat), or None if plain grouping is better."""
    if (df.count() if rows is None else rows) <= fingerprint_rows:
        return None
    tagged = df.withColumn("__fp", row_fingerprint(df))
    found = materialize(repeat_filter(tagged, FILTER_MAPS), "repeats")
    number, bit = _place("__fp", FILTER_MAPS)
    marked = tagged.withColumns({"__map": number, "__bit": bit}).join(F.broadcast(found), "__map", "left")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.col("__bit").bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    helpers = ("__fp", "__map", "__bit", "__bits")
    return marked.where(~hit).drop(*helpers), marked.where(hit).drop(*helpers)


def row_copies(df: DataFrame, fingerprint_rows: int = FINGERPRINT_ROWS) -> DataFrame:
    """Distinct rows with ``copies``, the number of times each occurs."""
    df = groupable(df)
    copies = F.count("*").alias("copies")
    parts = _split(df, fingerprint_rows)
    if parts is None:
        return df.groupBy(*[col(c) for c in df.columns]).agg(copies)
    unique, candidates = parts
    return unique.withColumn("copies", F.lit(1).cast("long")).unionByName(
        candidates.groupBy(*[col(c) for c in df.columns]).agg(copies)
    )


def duplicate_count(
    df: DataFrame, fingerprint_rows: int = FINGERPRINT_ROWS, rows: int | None = None
) -> DataFrame:
    """One row ``duplicates``: rows equal to an earlier row on every column. ``rows`` saves counting them."""
    df = groupable(df)
    parts = _split(df, fingerprint_rows, rows)
    candidates = df if parts is None else parts[1]
    return (
        candidates.groupBy(*[col(c) for c in df.columns])
        .agg(F.count("*").alias("__copies"))
        .agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).cast("long").alias("duplicates"))
    )


def drop_duplicate_rows(
    df: DataFrame, fingerprint_rows: int = FINGERPRINT_ROWS, rows: int | None = None
) -> DataFrame:
    """One copy of every row. Copies are equal, so first and last give the same table."""
    maps = [f.name for f in df.schema.fields if holds_map(f.dataType)]
    if maps:
        texts = {c: f"__text_{i}" for i, c in enumerate(maps)}
        keyed = df.select("*", *[F.to_json(col(c)).alias(t) for c, t in texts.items()])
        subset = [texts.get(c, c) for c in df.columns]
        return keyed.dropDuplicates(subset).drop(*texts.values())
    parts = _split(df, fingerprint_rows, rows)
    if parts is None:
        return df.dropDuplicates()
    unique, candidates = parts
    return unique.unionByName(candidates.dropDuplicates())


def keep_one_per_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], keep: str = "last"
) -> DataFrame:
    """First or last row of every key by ``order_by``; all columns break ties.

    ``max_by``/``min_by`` combine before the shuffle, so a hot key costs one row per task.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    rest = [c for c in df.columns if c not in order_by]
    order = F.struct(
        *[col(c).alias(f"o{i}") for i, c in enumerate([*order_by, *rest])]
    )
    pick = F.max_by if keep == "last" else F.min_by
    whole = F.struct(*[col(c) for c in df.columns])
    return (
        df.groupBy(*[col(c).alias(f"__key{i}") for i, c in enumerate(keys)])
        .agg(pick(whole, order).alias("__row"))
        .select("__row.*")
    )
