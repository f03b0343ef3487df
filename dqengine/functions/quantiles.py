"""Exact interpolated quantiles that never gather a whole column in one task.

The built-in ``percentile`` is exact but keeps every distinct value of a group in one
aggregation buffer, so it is used only for a small table. The values of groups are
counted and put in order over all tasks. Larger tables take three light scans: quantiles of a sample bracket
each wanted rank, the rows around the brackets are counted, and the few values inside are
grouped and ranked. Where those few would be many, the bracket is narrowed over several
rounds.
All buffers are bounded, and the counts make the result exact whatever error the sample
or the sketch has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.functions.columns import col, groupable
from dqengine.session import materialize

DIRECT_ROWS = 2_000_000
SMALL_ROWS = 200_000
SAMPLE_ROWS = 2_000_000
SAMPLE_SIGMAS = 6
GRID_CELLS = 128
GRID_ACCURACY = 10_000
MAX_ROUNDS = 40


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    direct_rows: int = DIRECT_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Rows ``(by..., column_name, probability, value)``.

    A whole column without data has a NULL value, a group without data has no row.
    Eager: it counts rows first (unless ``rows`` tells) to choose the method.
    """
    columns, by = list(columns), list(by)
    df = df.select(*[col(c) for c in dict.fromkeys(by + columns)])
    if not by:
        rows = df.count() if rows is None else rows
        if rows <= min(direct_rows, SMALL_ROWS):
            return _direct(df, columns, probabilities)
        found = _bracketed(df, columns, probabilities, rows, direct_rows)
        if found is not None:
            schema = "column_name string, probability double, value double"
            return df.sparkSession.createDataFrame(found, schema)
        return _narrowed(df, columns, probabilities, by, direct_rows)
    names = {(c, float(p)): f"__q{i}_{j}" for i, c in enumerate(columns) for j, p in enumerate(probabilities)}
    wide = group_values(df, columns, probabilities, [], by, names)
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.lit(p).alias("probability"), F.col(name).alias("value"))
        for (c, p), name in names.items()
    ]
    keys = [F.col(f"__k{i}").alias(c) for i, c in enumerate(by)]
    return wide.select(*keys, F.inline(F.array(*entries))).where("value is not null")


def quantile_values(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    direct_rows: int = DIRECT_ROWS,
    rows: int | None = None,
) -> dict[str, dict[float, float | None]]:
    """The few whole-table quantiles as plain numbers, one per column and probability."""
    result: dict[str, dict[float, float | None]] = {c: {} for c in columns}
    if not columns:
        return result
    for row in exact_quantiles(
        df, columns, probabilities, direct_rows=direct_rows, rows=rows
    ).collect():
        result[row["column_name"]][row["probability"]] = row["value"]
    for found in result.values():
        for p in probabilities:
            found.setdefault(p, None)
    return result


def _all_equal(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, [left.eqNullSafe(right) for left, right in pairs])


def _direct(df: DataFrame, columns: list[str], probabilities: Sequence[float]) -> DataFrame:
    wide = df.agg(
        *[
            F.percentile(col(c), [float(p) for p in probabilities]).alias(f"__q{i}")
            for i, c in enumerate(columns)
        ]
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(float(p)).alias("probability"),
            F.get(F.col(f"__q{i}"), F.lit(j)).alias("value"),
        )
        for i, c in enumerate(columns)
        for j, p in enumerate(probabilities)
    ]
    return wide.select(F.inline(F.array(*entries)))


def _long(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """One row ``(__k..., column_name, __v)`` per value that is there."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), col(c).cast("double").alias("__v"))
            for c in columns
        ]
    )
    return df.select(
        *[col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.inline(cells)
    ).where(F.col("__v").isNotNull())


def group_values(
    df: DataFrame,
    quantile_columns: Sequence[str],
    probabilities: Sequence[float],
    mode_columns: Sequence[str],
    by: Sequence[str],
    names: dict[tuple[str, float | str], str],
) -> DataFrame:
    """One row per group (``__k0``, …): exact quantiles and modes under the ``names`` of (column, share or "mode").

    One pass counts every value of every group and column, combined before the shuffle. The counted values are then
    put in order over all tasks, so the values of a large group lie in many of them: each task sums its own, the sums
    are passed on over the tasks, and only the values at the wanted ranks are kept. Modes come as text that casts back
    to the column's type; the smallest value wins a tie. A group without a value of a column has null there.
    """
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                (col(c).cast("double") if c in quantile_columns else F.lit(None).cast("double")).alias("__v"),
                (col(c).cast("string") if c in mode_columns else F.lit(None).cast("string")).alias("__t"),
            )
            for c in dict.fromkeys([*quantile_columns, *mode_columns])
        ]
    )
    keys = [f"__k{i}" for i in range(len(by))]
    long = df.select(*[col(c).alias(k) for c, k in zip(by, keys)], F.inline(cells))
    group = [*keys, "column_name"]
    counted = (
        long.where("__v is not null or __t is not null").groupBy(*group, "__v", "__t").agg(F.count("*").alias("__c"))
    )
    found = []
    if quantile_columns:
        spread = counted
        if mode_columns:  # both are read from one set of counts; text of one number may differ, as 0.0 and -0.0 do
            counted = materialize(counted, "group-counts")
            spread = counted.where("__v is not null").groupBy(*group, "__v").agg(F.sum("__c").alias("__c"))
        found.append(_at_ranks(spread, group, probabilities))
    if mode_columns:
        best = F.min_by("__t", F.struct(-F.col("__c"), "__v", "__t")).alias("__t")
        modes = counted.where("__t is not null").groupBy(*group).agg(best)
        found.append(modes.select(*group, F.lit(None).cast("double").alias("__p"), F.lit(None).cast("double").alias("__v"), "__t"))
    rows = reduce(DataFrame.unionByName, found)

    def one(column: str, kind: float | str) -> Column:
        own = (F.col("column_name") == column) & (F.col("__p").isNull() if kind == "mode" else F.col("__p") == kind)
        return F.max(F.when(own, F.col("__t" if kind == "mode" else "__v")))

    return rows.groupBy(*keys).agg(*[one(c, kind).alias(name) for (c, kind), name in names.items()])


def _at_ranks(counted: DataFrame, group: list[str], probabilities: Sequence[float]) -> DataFrame:
    """``(group..., __p, __v, __t)``: interpolated quantiles of counted values ``__v``, ``__c`` times each."""
    order = [*group, "__v"]
    placed = counted.select(*order, "__c").repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    placed = materialize(placed, "group-ranges")
    parts = placed.groupBy("__part", *group).agg(F.sum("__c").alias("__sum"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(c).alias(f"{c}_") for c in ("__part", *group)],
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__sum").over(whole).alias("__n"),
    )
    same = _all_equal([(F.col(c), F.col(f"{c}_")) for c in ("__part", *group)])
    inside = Window.partitionBy("__part", *group).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("__upto", F.sum("__c").over(inside)).join(parts, same)
    upto = F.col("__before") + F.col("__upto")
    shares = F.array(*[F.lit(float(p)) for p in probabilities])
    covers = ranked.select(*group, "__n", "__v", (upto - F.col("__c")).alias("__from"), upto.alias("__to"))
    at = covers.withColumn("__p", F.explode(F.filter(shares, _covered))).withColumn("__pos", F.col("__p") * (F.col("__n") - 1))

    def value(rank: Column) -> Column:
        return F.max(F.when((F.col("__from") <= rank) & (rank < F.col("__to")), F.col("__v")))

    picked = at.groupBy(*group, "__p", "__pos").agg(
        value(F.floor("__pos")).alias("__low"), value(F.ceil("__pos")).alias("__high")
    )
    low, high = F.floor("__pos"), F.ceil("__pos")
    between = (high - F.col("__pos")) * F.col("__low") + (F.col("__pos") - low) * F.col("__high")
    found = F.when(low == high, F.col("__low")).otherwise(between)
    return picked.select(*group, "__p", found.alias("__v"), F.lit(None).cast("string").alias("__t"))


def _covered(share: Column) -> Column:
    """Whether the rank before or after a share's position is among those of the value."""
    position = share * (F.col("__n") - 1)
    hits = [(F.col("__from") <= rank) & (rank < F.col("__to")) for rank in (F.floor(position), F.ceil(position))]
    return hits[0] | hits[1]


@dataclass(frozen=True)
class _Target:
    """One wanted quantile: its column, its share, and open or closed bracket ends."""

    column: str
    share: float
    low: float | None
    high: float | None

    def inside(self, value: Column) -> Column:
        above = F.lit(True) if self.low is None else value > self.low
        return above if self.high is None else above & (value < self.high)


def bracket_ends(columns: Sequence[str], probabilities: Sequence[float], margin: float = 2.0 / GRID_ACCURACY) -> list[Column]:
    """Aggregates of a mergeable summary: for each column the ends of the brackets of all shares."""
    asked = [min(1.0, max(0.0, e)) for p in probabilities for e in (p - margin, p + margin)]
    return [
        F.percentile_approx(col(c).cast("double"), asked, GRID_ACCURACY).alias(f"__e{i}") for i, c in enumerate(columns)
    ]


def bracket_targets(
    sketch: Row, columns: Sequence[str], probabilities: Sequence[float], margin: float = 2.0 / GRID_ACCURACY
) -> list[_Target]:
    """The brackets that the row of ``bracket_ends`` gives; ends beyond the lowest and highest share are open."""
    targets = []
    for i, c in enumerate(columns):
        for j, p in enumerate(probabilities):
            low, high = sketch[f"__e{i}"][2 * j : 2 * j + 2] if sketch[f"__e{i}"] else (None, None)
            targets.append(_Target(c, float(p), low if p > margin else None, high if p < 1.0 - margin else None))
    return targets


def _brackets(
    df: DataFrame, columns: list[str], probabilities: Sequence[float], rows: int
) -> list[_Target]:
    """Bracket ends from quantiles of a sample, wide enough to be missed hardly ever."""
    margin, sample = 2.0 / GRID_ACCURACY, df
    if rows > SAMPLE_ROWS:
        margin += SAMPLE_SIGMAS * math.sqrt(0.25 / SAMPLE_ROWS)
        sample = df.sample(SAMPLE_ROWS / rows, seed=7)
    sketch = sample.agg(*bracket_ends(columns, probabilities, margin)).first()
    return bracket_targets(sketch, columns, probabilities, margin)


def bracket_counts(columns: Sequence[str], targets: Sequence[_Target]) -> list[Column]:
    """Aggregates: values of each column, and those below, at the ends of and inside each bracket."""
    measures = [F.count(col(c)).alias(f"__n_{i}") for i, c in enumerate(columns)]
    for k, t in enumerate(targets):
        value, none = col(t.column).cast("double"), F.lit(0).cast("long")
        measures += [
            (none if t.low is None else F.count_if(value < t.low)).alias(f"__less{k}"),
            (none if t.low is None else F.count_if(value == t.low)).alias(f"__low{k}"),
            F.count_if(t.inside(value)).alias(f"__mid{k}"),
            (none if t.high in (None, t.low) else F.count_if(value == t.high)).alias(f"__high{k}"),
        ]
    return measures


def _bracketed(
    df: DataFrame, columns: list[str], probabilities: Sequence[float], rows: int, direct_rows: int
) -> list[tuple[str, float, float | None]] | None:
    """Three scans; None if a bracket missed its rank or holds too many rows."""
    targets = _brackets(df, columns, probabilities, rows)
    return at_brackets(df, columns, targets, df.agg(*bracket_counts(columns, targets)).first(), direct_rows)


def at_brackets(
    df: DataFrame, columns: Sequence[str], targets: list[_Target], counts: Row, direct_rows: int = DIRECT_ROWS
) -> list[tuple[str, float, float | None]] | None:
    """Exact quantiles from the counts around brackets, and a scan for the values inside; None if one missed its rank.

    A bracket spans a small share of the rows. A value that fills more than that share is
    itself an end of the bracket, so it does not count as inside.
    """
    columns = list(columns)
    known: dict[tuple[int, int], float] = {}
    picks: list[tuple[int, int]] = []
    for k, t in enumerate(targets):
        n = counts[f"__n_{columns.index(t.column)}"]
        if not n:
            continue
        position = t.share * (n - 1)
        first_mid = counts[f"__less{k}"] + counts[f"__low{k}"]
        first_high = first_mid + counts[f"__mid{k}"]
        for rank in {math.floor(position), math.ceil(position)}:
            if counts[f"__less{k}"] <= rank < first_mid:
                known[(k, rank)] = t.low
            elif first_mid <= rank < first_high and counts[f"__mid{k}"] <= direct_rows:
                picks.append((k, rank - first_mid))
            elif first_high <= rank < first_high + counts[f"__high{k}"]:
                known[(k, rank)] = t.high
            else:
                return None
    for k, at, value in _ranked_inside(df, targets, picks):
        known[(k, at + counts[f"__less{k}"] + counts[f"__low{k}"])] = value

    found = []
    for k, t in enumerate(targets):
        n = counts[f"__n_{columns.index(t.column)}"]
        if not n:
            found.append((t.column, t.share, None))
            continue
        position = t.share * (n - 1)
        rank, after = math.floor(position), math.ceil(position)
        value = known[(k, rank)]
        if after != rank:
            value = (after - position) * value + (position - rank) * known[(k, after)]
        found.append((t.column, t.share, value))
    return found


def _ranked_inside(
    df: DataFrame, targets: list[_Target], picks: list[tuple[int, int]]
) -> list[tuple[int, int, float]]:
    """``(target, place, value)`` of the wanted places inside brackets of bounded size."""
    if not picks:
        return []
    needed = sorted({k for k, _ in picks})
    hits = {k: targets[k].inside(col(targets[k].column).cast("double")) for k in needed}
    any_hit = reduce(lambda a, b: a | b, hits.values())
    cells = [
        F.when(hit, F.struct(F.lit(k).alias("k"), col(targets[k].column).cast("double").alias("v")))
        for k, hit in hits.items()
    ]
    counted = (
        df.where(any_hit)
        .select(F.inline(F.array_compact(F.array(*cells))))
        .groupBy("k", "v")
        .agg(F.count("*").alias("c"))
    )
    running = Window.partitionBy("k").orderBy("v")
    ranked = counted.withColumn("upto", F.sum("c").over(running))
    wanted = reduce(
        lambda a, b: a | b,
        [
            (F.col("k") == k) & (F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)
            for k, at in picks
        ],
    )
    rows = ranked.where(wanted).collect()
    return [
        (k, at, row["v"])
        for k, at in picks
        for row in rows
        if row["k"] == k and row["upto"] - row["c"] <= at < row["upto"]
    ]


def _narrowed(
    df: DataFrame,
    columns: list[str],
    probabilities: Sequence[float],
    by: list[str],
    direct_rows: int,
) -> DataFrame:
    keys = [f"__k{i}" for i in range(len(by))] + ["column_name"]
    values = _long(df, columns, by)
    sizes = materialize(values.groupBy(*keys).agg(F.count("*").alias("__n")))
    positions = sizes.select(
        *keys,
        F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability"),
        "__n",
    ).withColumn("__pos", F.col("probability") * (F.col("__n") - 1))
    targets = (
        positions.select(
            *keys,
            F.explode(
                F.array(F.floor("__pos").cast("long"), F.ceil("__pos").cast("long"))
            ).alias("__rank"),
        )
        .distinct()
        .select(
            *keys,
            "__rank",
            F.lit(None).cast("double").alias("__lo"),
            F.lit(None).cast("double").alias("__hi"),
        )
    )
    found: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        state = materialize(_count_around(values, targets, keys).select("*", *_verdict(direct_rows)))
        found.append(state.where("__value is not null").select(*keys, "__rank", "__value"))
        gather = state.where("__step = 'gather'")
        if not gather.isEmpty():
            found.append(materialize(_pick(values, gather, keys)))
        targets = state.where("__step = 'narrow'").select(
            *keys, "__rank", F.col("__new_lo").alias("__lo"), F.col("__new_hi").alias("__hi")
        )
        if targets.isEmpty():
            break
    else:
        raise RuntimeError("quantile brackets did not close")

    values_by_rank = reduce(DataFrame.unionByName, found)
    low = values_by_rank.select(
        *keys, F.col("__rank").alias("__low"), F.col("__value").alias("__low_value")
    )
    high = values_by_rank.select(
        *keys, F.col("__rank").alias("__high"), F.col("__value").alias("__high_value")
    )
    ranked = positions.withColumn("__low", F.floor("__pos").cast("long")).withColumn(
        "__high", F.ceil("__pos").cast("long")
    )
    joined = _join_keys(ranked, low, keys + ["__low"])
    joined = _join_keys(joined, high, keys + ["__high"])
    share = F.col("__pos") - F.col("__low")
    value = F.when(
        F.col("__low") == F.col("__high"), F.col("__low_value")
    ).otherwise(
        (F.col("__high") - F.col("__pos")) * F.col("__low_value") + share * F.col("__high_value")
    )
    return joined.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(by)],
        "column_name",
        "probability",
        value.alias("value"),
    )


def _join_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(
        *[F.col(c).alias(f"{c}__r") if c in keys else F.col(c) for c in right.columns]
    )
    on = _all_equal([(F.col(c), F.col(f"{c}__r")) for c in keys])
    return left.join(renamed, on, "inner").drop(*[f"{c}__r" for c in keys])


def _inside() -> Column:
    above = F.col("__lo").isNull() | (F.col("__v") > F.col("__lo"))
    below = F.col("__hi").isNull() | (F.col("__v") < F.col("__hi"))
    return above & below


def _count_around(values: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    grid = [i / GRID_CELLS for i in range(GRID_CELLS + 1)]
    value, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
    return (
        _join_keys(values, F.broadcast(targets), keys)
        .groupBy(*keys, "__rank", "__lo", "__hi")
        .agg(
            F.count_if(value < lo).alias("__less"),
            F.count_if(value == lo).alias("__at_lo"),
            F.count_if(_inside()).alias("__mid"),
            F.count_if((value == hi) & ~lo.eqNullSafe(hi)).alias("__at_hi"),
            F.percentile_approx(F.when(_inside(), value), grid, GRID_ACCURACY).alias("__grid"),
        )
    )


def _verdict(direct_rows: int) -> list[Column]:
    rank, lo, hi, mid = (F.col(c) for c in ("__rank", "__lo", "__hi", "__mid"))
    first_mid = F.col("__less") + F.col("__at_lo")
    first_hi = first_mid + mid
    local = rank - first_mid
    cell = F.floor(local.cast("double") / F.greatest(mid, F.lit(1)) * GRID_CELLS).cast("int")
    missed_low = rank < F.col("__less")
    on_lo = ~missed_low & (rank < first_mid)
    in_mid = (rank >= first_mid) & (rank < first_hi)
    on_hi = (rank >= first_hi) & (rank < first_hi + F.col("__at_hi"))
    value = F.when(on_lo, lo).when(on_hi, hi)
    step = (
        F.when(on_lo | on_hi, "done")
        .when(in_mid & (mid <= direct_rows), "gather")
        .otherwise("narrow")
    )
    new_lo = (
        F.when(missed_low, F.lit(None))
        .when(in_mid, F.when(cell >= 1, F.get(F.col("__grid"), cell - 1)).otherwise(lo))
        .otherwise(hi)
    )
    new_hi = (
        F.when(missed_low, lo)
        .when(
            in_mid,
            F.when(cell + 2 <= GRID_CELLS, F.get(F.col("__grid"), cell + 2)).otherwise(hi),
        )
        .otherwise(F.lit(None))
    )
    return [
        value.alias("__value"),
        step.alias("__step"),
        local.alias("__local"),
        new_lo.cast("double").alias("__new_lo"),
        new_hi.cast("double").alias("__new_hi"),
    ]


def _pick(values: DataFrame, gather: DataFrame, keys: list[str]) -> DataFrame:
    """The ranked value inside brackets that hold at most ``direct_rows`` rows each."""
    few = gather.select(*keys, "__rank", "__lo", "__hi", "__local")
    counted = (
        _join_keys(values, F.broadcast(few), keys)
        .where(_inside())
        .groupBy(*keys, "__rank", "__local", "__v")
        .agg(F.count("*").alias("__c"))
    )
    running = Window.partitionBy(*keys, "__rank").orderBy("__v")
    return (
        counted.withColumn("__upto", F.sum("__c").over(running))
        .where((F.col("__upto") > F.col("__local")) & (F.col("__upto") - F.col("__c") <= F.col("__local")))
        .select(*keys, "__rank", F.col("__v").alias("__value"))
    )


def most_frequent_values(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value of each column; the smallest wins a tie.

    Plain values come as text, which casts back without loss; arrays, structs and binary as
    what they are. One grouped count per column: the distinct values stay spread over the
    shuffle and only one row per column reaches the driver.
    """
    if not columns:
        return {}
    df = groupable(df)
    whole = [c for c in columns if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.BinaryType))]
    found: dict[str, object] = {}
    for c in whole:
        counted = df.where(col(c).isNotNull()).groupBy(col(c).alias("__v")).agg(F.count("*").alias("__c"))
        top = counted.orderBy(F.desc("__c"), F.asc("__v")).first()
        found[c] = top["__v"] if top else None
    plain = [c for c in columns if c not in whole]
    if not plain:
        return found
    tops = [
        df.where(col(c).isNotNull())
        .groupBy(col(c).alias("__v"))
        .agg(F.count("*").alias("__c"))
        .orderBy(F.desc("__c"), F.asc("__v"))
        .limit(1)
        .select(F.lit(c).alias("column_name"), F.col("__v").cast("string").alias("value"))
        for c in plain
    ]
    rows = reduce(DataFrame.unionAll, tops).collect()
    found |= {row["column_name"]: row["value"] for row in rows}
    return {c: found.get(c) for c in columns}
