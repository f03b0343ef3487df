"""Repair methods and the fold that applies a list of actions.

Like an estimator, a repair first computes the few numbers it needs from the current
table (means, quantiles, modes) and then rewrites the table lazily with them. Actions
that neither touch a column twice nor follow a change of rows share one set of numbers,
so the table is scanned once per stage and not once per action.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.functions.columns import col, nan_to_null
from dqengine.functions.quantiles import (
    DIRECT_ROWS,
    group_values,
    most_frequent_values,
    quantile_values,
)
from dqengine.operators.duplicates import FINGERPRINT_ROWS, drop_duplicate_rows, duplicate_count, keep_one_per_key
from dqengine.operators.facts import Facts
from dqengine.operators.fill import ROWS_PER_CHUNK, fill_along
from dqengine.operators.profile import z_score
from dqengine.schemas import (
    EXECUTION_LOG_SCHEMA,
    HANDLE_NULLS,
    HANDLE_OUTLIERS,
    REMOVE_DUPLICATES,
    RULES,
    QualityRules,
)
from dqengine.session import materialize

# Method names, grouped by what they do to the table.
FILL_FROM_STATISTIC = {"FILL_MEAN": "mean", "FILL_MEDIAN": "median", "FILL_MODE": "mode"}
FILL_DEFAULT = "FILL_DEFAULT"
DEFAULT_TEXT = "Unknown"
DROP_NULL_ROWS = ("DELETE_ROWS", "DROP_ROWS")
DEDUPLICATE = (
    "KEEP_FIRST",
    "KEEP_LAST",
    "DUPLICATE_REMOVE",
    "DUPLICATE_KEEP_FIRST",
    "DUPLICATE_KEEP_LAST",
)
Z_FILTERS = ("REMOVE_OUTLIERS", "OUTLIER_ZSCORE")
CLIPS = {
    "CAP_OUTLIERS": (None, "p95"),
    "OUTLIER_PERCENTILE": ("p05", "p95"),
    "OUTLIER_IQR": ("fence_low", "fence_high"),
}
LOG_TRANSFORM = "LOG_TRANSFORM"
ORDERED_FILLS = {"FILL_FORWARD": True, "FILL_BACKWARD": False}
DROP_COLUMNS = "DROP_COLUMNS"
CUSTOM = "CUSTOM_TRANSFORMATION"

#: Methods that write fractions into numeric columns.
REWRITTEN = ("FILL_MEAN", "FILL_MEDIAN", *CLIPS)
QUANTILES = {"median": 0.5, "p05": 0.05, "p95": 0.95, "q1": 0.25, "q3": 0.75}
NUMERIC_ONLY = {"FILL_MEAN", "FILL_MEDIAN", LOG_TRANSFORM, *CLIPS, *Z_FILTERS}


@dataclass(frozen=True)
class Action:
    """One repair step. ``options``: keys, order_by, keep, cast_to_text, transform."""

    action_type: str
    method: str
    column: str | None = None
    action_id: str = ""
    options: dict = field(default_factory=dict, compare=False)

    @property
    def key(self) -> str:
        return self.action_id or f"{self.action_type}:{self.column or '*'}"


@dataclass
class Healed:
    """Repaired table and what happened, one entry per action."""

    df: DataFrame
    entries: list[dict]

    @property
    def log(self) -> DataFrame:
        rows = [tuple(e[f.name] for f in EXECUTION_LOG_SCHEMA.fields) for e in self.entries]
        return self.df.sparkSession.createDataFrame(rows, EXECUTION_LOG_SCHEMA)


Statistic = Callable[[str, str], Column]

#: Whole numbers up to here are exact as double, as are decimals of this precision.
DOUBLE_WHOLE, DOUBLE_DIGITS = 1 << 53, 15
#: Decimal places that a filled-in or capped cell keeps at least, if the column has room for them.
DECIMAL_PLACES = 6


Kinds = dict[str, T.DataType]


def _beyond(column: str) -> Column:
    """Whether any whole number of a column is too large for a double."""
    return F.bool_or(~col(column).between(-DOUBLE_WHOLE, DOUBLE_WHOLE))


def _fractions_of(df: DataFrame, actions: Sequence[Action], large: set[str]) -> Kinds:
    """The type that holds the old and the new cells of every column that a mean, median or cap rewrites.

    That is double where it holds all cells exactly, else a decimal: for long decimals, and for the ``large`` columns
    of whole numbers, which have some beyond 2 ** 53.
    """
    kinds: Kinds = {}
    for name in {a.column for a in actions if a.method in REWRITTEN}:
        kind = df.schema[name].dataType
        kinds[name] = T.DoubleType()
        if isinstance(kind, T.LongType) and name in large:
            kinds[name] = T.DecimalType(38, DECIMAL_PLACES)
        elif isinstance(kind, T.DecimalType) and kind.precision > DOUBLE_DIGITS:
            scale = max(kind.scale, min(DECIMAL_PLACES, 38 - (kind.precision - kind.scale)))
            kinds[name] = T.DecimalType(38, scale)
    return kinds


def _long_columns(df: DataFrame, actions: Sequence[Action]) -> list[str]:
    names = {a.column for a in actions if a.method in REWRITTEN}
    return sorted(c for c in names if isinstance(df.schema[c].dataType, T.LongType))


def _needs(action: Action) -> tuple[str, ...]:
    method = action.method
    if method in FILL_FROM_STATISTIC:
        return (FILL_FROM_STATISTIC[method],)
    if method in Z_FILTERS:
        return ("mean", "std")
    if method == "OUTLIER_IQR":
        return ("q1", "q3")
    if method in CLIPS:
        return tuple(x for x in CLIPS[method] if x)
    return ()


def _changes_rows(action: Action) -> bool:
    value_methods = {*FILL_FROM_STATISTIC, FILL_DEFAULT, *CLIPS, LOG_TRANSFORM}
    return action.method not in value_methods


def _stages(actions: Sequence[Action]) -> list[list[Action]]:
    """Runs of actions whose numbers can be read from the same table."""
    stages: list[list[Action]] = []
    current: list[Action] = []
    for action in actions:
        touched = {a.column for a in current}
        if current and (_changes_rows(current[-1]) or action.column in touched):
            stages.append(current)
            current = []
        current.append(action)
    return stages + [current] if current else stages


def _problem(df: DataFrame, action: Action) -> str | None:
    """Why an action cannot run, or None."""
    known = {
        *FILL_FROM_STATISTIC, FILL_DEFAULT, *DROP_NULL_ROWS, *DEDUPLICATE, *Z_FILTERS, *CLIPS,
        LOG_TRANSFORM, *ORDERED_FILLS, DROP_COLUMNS, CUSTOM,
    }
    if action.method not in known:
        return f"unknown method {action.method}"
    if action.method in DEDUPLICATE or action.method == CUSTOM:
        return None
    if action.column not in df.columns:
        return f"no column {action.column}"
    kind = df.schema[action.column].dataType
    if action.method in NUMERIC_ONLY and not isinstance(kind, T.NumericType):
        return f"column {action.column} is not numeric"
    if (
        action.method == FILL_DEFAULT
        and not isinstance(kind, T.StringType)
        and not action.options.get("cast_to_text")
    ):
        return f"column {action.column} is not text"
    if action.method in ORDERED_FILLS and not action.options.get("order_by"):
        return f"{action.method} needs an order"
    return None


def _fences(stat: Statistic, column: str, rules: QualityRules) -> tuple[Column, Column]:
    q1, q3 = stat(column, "q1"), stat(column, "q3")
    spread = F.lit(rules.iqr_factor) * (q3 - q1)
    return q1 - spread, q3 + spread


def _clip_limits(action: Action, stat: Statistic, rules: QualityRules) -> tuple[Column | None, Column]:
    if action.method == "OUTLIER_IQR":
        return _fences(stat, action.column, rules)
    low, high = CLIPS[action.method]
    return (stat(action.column, low) if low else None), stat(action.column, high)


def _changed(action: Action, stat: Statistic, rules: QualityRules) -> Column | None:
    """Condition for "this cell changes" or "this row goes", on the table before the action."""
    if action.method in DEDUPLICATE or action.method in ORDERED_FILLS or action.method in (DROP_COLUMNS, CUSTOM):
        return None
    value = col(action.column)
    if action.method in FILL_FROM_STATISTIC:
        return value.isNull() & stat(action.column, FILL_FROM_STATISTIC[action.method]).isNotNull()
    if action.method == FILL_DEFAULT or action.method in DROP_NULL_ROWS:
        return value.isNull()
    if action.method == LOG_TRANSFORM:
        return value.isNotNull()
    if action.method in Z_FILTERS:
        return ~F.coalesce(_within(action, stat, rules), F.lit(False))
    low, high = _clip_limits(action, stat, rules)
    value = value.cast("double")
    return (value > high) | (value < low) if low is not None else value > high


def _within(action: Action, stat: Statistic, rules: QualityRules) -> Column:
    mean = stat(action.column, "mean").cast("double")
    score = z_score(col(action.column), mean, stat(action.column, "std"))
    return score <= rules.outlier_std_threshold


def _rewrite(
    df: DataFrame, action: Action, stat: Statistic, rules: QualityRules, kinds: Kinds, rows: int | None = None
) -> DataFrame:
    """The table after one action; lazy. ``kinds`` are the types of columns whose cells become fractions, ``rows``
    is the number of rows of the table, if known.

    Cells that do not change are only brought to that type, never computed with.
    """
    method, name = action.method, action.column
    if method in FILL_FROM_STATISTIC:
        filler = stat(name, FILL_FROM_STATISTIC[method])
        if method == "FILL_MODE":
            return _replace(df, name, F.coalesce(col(name), filler))
        return _replace(df, name, F.coalesce(col(name).cast(kinds[name]), filler.cast(kinds[name])))
    if method == FILL_DEFAULT:
        return _replace(df, name, F.coalesce(col(name).cast("string"), F.lit(DEFAULT_TEXT)))
    if method in DROP_NULL_ROWS:
        return df.where(col(name).isNotNull())
    if method in DEDUPLICATE:
        keys = action.options.get("keys")
        if keys:
            keep = "last" if method.endswith("LAST") else "first"
            return keep_one_per_key(df, keys, action.options["order_by"], keep)
        return drop_duplicate_rows(df, action.options.get("fingerprint_rows", FINGERPRINT_ROWS), rows)
    if method in Z_FILTERS:
        return df.where(_within(action, stat, rules))
    if method in CLIPS:
        low, high = _clip_limits(action, stat, rules)
        value = col(name).cast("double")
        capped = F.when(value > high, high.cast(kinds[name]))
        if low is not None:
            capped = capped.when(value < low, low.cast(kinds[name]))
        return _replace(df, name, capped.otherwise(col(name).cast(kinds[name])))
    if method == LOG_TRANSFORM:
        return _replace(df, name, F.log1p(col(name).cast("double")))
    if method in ORDERED_FILLS:
        return fill_along(
            df,
            name,
            action.options["order_by"],
            action.options.get("keys", ()),
            forward=ORDERED_FILLS[method],
            rows_per_chunk=action.options.get("rows_per_chunk", ROWS_PER_CHUNK),
        )
    if method == DROP_COLUMNS:
        return df.select(*[col(c) for c in df.columns if c != name])
    return df.transform(action.options["transform"])


def _replace(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select(*[value.alias(c) if c == name else col(c) for c in df.columns])


def _read_statistics(
    df: DataFrame, actions: Sequence[Action], direct_rows: int, count: bool, known: Facts | None = None
) -> tuple[int | None, dict[tuple[str, str], object], Kinds]:
    """Row count, the numbers the actions need, and types of fractions: one aggregation, plus quantiles and modes.

    Numbers that are ``known`` of this very table are not read again.
    """
    wanted = {(a.column, kind) for a in actions for kind in _needs(a)}
    if not wanted and not count:
        return None, {}, {}
    if known is not None and not _long_columns(df, actions):
        kinds = _fractions_of(df, actions, set())
        found = {w: known.number(*w, QUANTILES.get(w[1])) for w in wanted if w[1] != "mode"}
        if all(have for have, _ in found.values()) and not any(isinstance(k, T.DecimalType) for k in kinds.values()):
            numbers = {w: value for w, (_, value) in found.items()}
            modes = most_frequent_values(df, sorted(c for c, kind in wanted if kind == "mode"))
            return known.rows, numbers | {(c, "mode"): text for c, text in modes.items()}, kinds
    moments = sorted(w for w in wanted if w[1] in ("mean", "std"))
    longs = _long_columns(df, actions)
    row = df.agg(
        F.count("*").alias("n"),
        *[_moment(c, kind).alias(f"__m{i}") for i, (c, kind) in enumerate(moments)],
        *[_exact_mean(df, c, kind).alias(f"__e{i}") for i, (c, kind) in enumerate(moments)],
        *[_beyond(c).alias(f"__b{i}") for i, c in enumerate(longs)],
    ).first()
    kinds = _fractions_of(df, actions, {c for i, c in enumerate(longs) if row[f"__b{i}"]})
    numbers: dict[tuple[str, str], object] = {}
    for i, (c, kind) in enumerate(moments):
        exact = isinstance(kinds.get(c), T.DecimalType) and row[f"__e{i}"] is not None
        numbers[(c, kind)] = row[f"__e{i}"] if exact else row[f"__m{i}"]
    quantile_columns = sorted({c for c, kind in wanted if kind in QUANTILES})
    shares = sorted({QUANTILES[kind] for _, kind in wanted if kind in QUANTILES})
    found = quantile_values(df, quantile_columns, shares, direct_rows, rows=row["n"])
    numbers.update(
        {(c, kind): found[c][QUANTILES[kind]] for c, kind in wanted if kind in QUANTILES}
    )
    modes = most_frequent_values(df, sorted(c for c, kind in wanted if kind == "mode"))
    numbers.update({(c, "mode"): text for c, text in modes.items()})
    return row["n"], numbers, kinds


def _moment(column: str, kind: str) -> Column:
    return F.avg(col(column)).cast("double") if kind == "mean" else F.stddev_samp(col(column).cast("double"))


def _exact_mean(df: DataFrame, column: str, kind: str) -> Column:
    """Quotient of exact sums for whole numbers and decimals; null if it is no such mean or the sum does not fit."""
    declared = df.schema[column].dataType
    if kind != "mean" or not isinstance(declared, (T.LongType, T.DecimalType)):
        return F.lit(None).cast("decimal(38,6)")
    scale = 0 if isinstance(declared, T.LongType) else declared.scale
    total = F.try_sum(col(column).cast(T.DecimalType(38, scale)))
    return F.try_divide(total, F.count(col(column)))


def _literals(df: DataFrame, numbers: dict[tuple[str, str], object]) -> Statistic:
    def stat(column: str, kind: str) -> Column:
        number = numbers[(column, kind)]
        if kind != "mode":
            return F.lit(number).cast("double") if number is None or isinstance(number, float) else F.lit(number)
        wanted = df.schema[column].dataType
        if number is None or isinstance(number, str):
            return F.lit(number).cast(wanted)
        one = df.sparkSession.createDataFrame([(number,)], T.StructType([T.StructField("mode", wanted)]))
        return one.scalar()

    return stat


def _reason(error: Exception) -> str:
    """What a step failed with, in one line."""
    return str(error).strip().split("\n")[0][:300] or type(error).__name__


def _failure(run: Callable[[], object]) -> str | None:
    """What a step failed with, or None. Whatever an action raises, the others go on."""
    try:
        run()
    except Exception as error:
        return _reason(error)
    return None


def heal(
    df: DataFrame,
    actions: Sequence[Action],
    rules: QualityRules = RULES,
    measure: bool = True,
    write_end: bool = False,
    write_after: int = 4,
    direct_rows: int = DIRECT_ROWS,
    known: Facts | None = None,
) -> Healed:
    """Apply the actions in order, each on the result of the one before.

    Actions that cannot run are logged and skipped. A custom transformation may fail on any
    value, so the table is written before it (a savepoint) and after it, at once: if either the
    function or its run raises, the fold goes on from the savepoint. ``measure`` counts changed
    cells and removed rows for the log. Between stages the table is written to the shared folder
    after a step that shuffles it, and after every ``write_after`` row-changing steps:
    later scans then neither repeat the shuffle nor carry an ever longer plan.
    ``write_end`` does the same with the final table, for callers that scan it again.
    ``known`` are facts of ``df``, which save the first stage from reading its numbers.
    """
    current = nan_to_null(df)
    entries: list[dict] = []
    unsaved = 0
    stages = _stages(actions)
    for number, stage in enumerate(stages):
        last = number + 1 == len(stages)
        ready, failed = [], {}
        for action in stage:
            reason = _problem(current, action)
            if reason:
                failed[action.key] = reason
            else:
                ready.append(action)
        try:
            facts = known if number == 0 else None
            rows, numbers, kinds = _read_statistics(current, ready, direct_rows, measure, facts)
        except Exception:
            # Find the actions whose numbers cannot be read; the others go on.
            for action in list(ready):
                if error := _failure(lambda a=action: _read_statistics(current, [a], direct_rows, False)):
                    failed[action.key] = error
                    ready.remove(action)
            rows, numbers, kinds = _read_statistics(current, ready, direct_rows, measure)
        stat = _literals(current, numbers)
        for action in list(ready):
            if action.method == CUSTOM or action.method in DEDUPLICATE and not action.options.get("keys"):
                continue
            # Analysis finds what cannot run on this table before anything is counted.
            if error := _failure(lambda a=action: _rewrite(current, a, stat, rules, kinds).schema):
                failed[action.key] = error
                ready.remove(action)
        for action in list(ready):
            if action.method == "FILL_MODE" and numbers[(action.column, "mode")] is None:
                failed[action.key] = f"column {action.column} has no value"
                ready.remove(action)
        counts = _measure(current, ready, stat, rules) if measure else {}
        for action in stage:
            if action.key in failed:
                entries.append(_entry(action, rows, rows, 0, failed[action.key], len(entries)))
                continue
            before = current
            if action.method == CUSTOM:
                if unsaved:
                    current, unsaved = materialize(current), 0
                try:
                    current = materialize(_rewrite(current, action, stat, rules, kinds))
                except Exception as error:
                    entries.append(_entry(action, rows, rows, 0, _reason(error), len(entries)))
                    continue
                rows, old = (current.count() if measure else None), rows
                entries.append(_entry(action, old, rows, 0 if measure else None, None, len(entries)))
                continue
            current = _rewrite(current, action, stat, rules, kinds, rows)
            after, cells = rows, counts.get(action.key)
            if not measure:
                entries.append(_entry(action, None, None, None, None, len(entries)))
                unsaved += _changes_rows(action)
                continue
            if action.method in DEDUPLICATE:
                if last and not write_end:
                    after = _rows_after(before, current, action, rows)
                else:
                    current = materialize(current)
                    after, unsaved = current.count(), 0
                    entries.append(_entry(action, rows, after, 0, None, len(entries)))
                    continue
            elif action.method in DROP_NULL_ROWS or action.method in Z_FILTERS:
                after, cells = rows - cells, 0
            entries.append(_entry(action, rows, after, cells or 0, None, len(entries)))
            unsaved += _changes_rows(action)
        shuffled = any(a.method in DEDUPLICATE or a.method in ORDERED_FILLS for a in ready)
        if unsaved > 0 and (shuffled or unsaved >= write_after) and (write_end or not last):
            current, unsaved = materialize(current), 0
    return Healed(current, entries)


def _rows_after(before: DataFrame, after: DataFrame, action: Action, rows: int) -> int:
    if action.options.get("keys"):
        return after.count()
    return rows - duplicate_count(before, rows=rows).first()["duplicates"]


def _measure(
    df: DataFrame, actions: Sequence[Action], stat: Statistic, rules: QualityRules
) -> dict[str, int]:
    """Changed cells or removed rows per action, in one scan."""
    conditions = [(a.key, _changed(a, stat, rules)) for a in actions]
    conditions = [(key, c) for key, c in conditions if c is not None]
    if not conditions:
        return {}
    row = df.agg(*[F.count_if(c).alias(f"__c{i}") for i, (_, c) in enumerate(conditions)]).first()
    return {key: row[i] for i, (key, _) in enumerate(conditions)}


def _entry(
    action: Action,
    before: int | None,
    after: int | None,
    cells: int | None,
    failure: str | None,
    done: int,
) -> dict:
    # These texts are results.
    message = (
        f"Execution failed: {failure}"
        if failure
        else f"Successfully executed {action.action_type} using {action.method}"
    )
    return {
        "step": done + 1,
        "action_id": action.key,
        "action_type": action.action_type,
        "column_name": action.column,
        "method": action.method,
        "rows_before": before,
        "rows_after": after,
        "records_affected": None if after is None else before - after,
        "cells_changed": cells,
        "success": failure is None,
        "message": message,
    }


def repair(df: DataFrame, method: str, column: str | None = None, **options: object) -> DataFrame:
    """Apply one method and return the table."""
    kind = REMOVE_DUPLICATES if method in DEDUPLICATE else HANDLE_NULLS
    if method in CLIPS or method in Z_FILTERS or method == LOG_TRANSFORM:
        kind = HANDLE_OUTLIERS
    action = Action(kind, method, column, options=dict(options))
    healed = heal(df, [action], measure=False)
    if not healed.entries[0]["success"]:
        raise ValueError(healed.entries[0]["message"])
    return healed.df


GROUP_BROADCAST = 200_000


def _casts_back(df: DataFrame, column: str) -> bool:
    """Whether values of a column, as text, sort and come back as they are."""
    return isinstance(df.schema[column].dataType, (T.StringType, T.BooleanType, T.DateType))


def _group_statistics(
    df: DataFrame, actions: Sequence[Action], group: Sequence[str], direct_rows: int
) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """One row per group with the numbers the actions need, and the name of each number."""
    wanted = sorted({(a.column, kind) for a in actions for kind in _needs(a)})
    names = {key: f"__s{i}" for i, key in enumerate(wanted)}
    keys = {c: f"__g{i}" for i, c in enumerate(group)}
    by = [col(c).alias(k) for c, k in keys.items()]
    sums = [
        (F.avg(col(c)) if kind == "mean" else F.stddev_samp(col(c).cast("double"))).alias(names[(c, kind)])
        for c, kind in wanted
        if kind in ("mean", "std")
    ]
    stats = df.groupBy(*by).agg(F.count("*").alias("__rows"), *sums)

    def attach(other: DataFrame) -> DataFrame:
        renamed = other.select(
            *[col(k).alias(k + "r") for k in keys.values()],
            *[c for c in other.columns if c not in keys.values()],
        )
        same = reduce(
            lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(k + "r")) for k in keys.values()]
        )
        return stats.join(renamed, same, "left").drop(*[k + "r" for k in keys.values()])

    plain = {c for c, kind in wanted if kind == "mode" and _casts_back(df, c)}
    asked = [(c, kind) for c, kind in wanted if kind in QUANTILES or c in plain and kind == "mode"]
    if asked:
        shares = sorted({QUANTILES[kind] for _, kind in asked if kind in QUANTILES})
        columns = sorted({c for c, kind in asked if kind in QUANTILES})
        wide = group_values(
            df, columns, shares, sorted(plain), group, {(c, QUANTILES.get(kind, kind)): names[(c, kind)] for c, kind in asked}
        )
        for c in plain:
            wide = wide.withColumn(names[(c, "mode")], F.col(names[(c, "mode")]).cast(df.schema[c].dataType))
        stats = attach(wide.withColumnsRenamed({f"__k{i}": k for i, k in enumerate(keys.values())}))
    for c, kind in wanted:
        if kind == "mode" and c not in plain:
            counted = (
                df.where(col(c).isNotNull())
                .groupBy(*by, col(c).alias("__v"))
                .agg(F.count("*").alias("__c"))
            )
            best = counted.groupBy(*keys.values()).agg(
                F.min_by("__v", F.struct(-F.col("__c"), F.col("__v"))).alias(names[(c, "mode")])
            )
            stats = attach(best)
    return stats, names


def heal_by_group(
    df: DataFrame,
    actions: Sequence[Action],
    group: Sequence[str],
    rules: QualityRules = RULES,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Repair with the statistics of each row's own group instead of the whole table's.

    Stands for repairing a table part by part. Group numbers are partial aggregates, so a
    hot group costs no more than others; they are broadcast only if the groups are few.
    """
    current = nan_to_null(df)
    stages = _stages(actions)
    for stage in stages:
        for action in stage:
            reason = _problem(current, action)
            if reason:
                raise ValueError(reason)
        columns = current.columns
        if any(_needs(a) for a in stage):
            stats, names = _group_statistics(current, stage, group, direct_rows)
            stats = materialize(stats)
            few = stats.count() <= GROUP_BROADCAST
            same = reduce(
                lambda a, b: a & b,
                [col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)],
            )
            current = current.join(F.broadcast(stats) if few else stats, same, "left")

            def stat(column: str, kind: str, names: dict = names) -> Column:
                return F.col(names[(column, kind)])
        else:

            def stat(column: str, kind: str) -> Column:
                raise KeyError((column, kind))

        longs = _long_columns(current, stage)
        large = current.agg(*map(_beyond, longs)).first() if longs else ()
        kinds = _fractions_of(current, stage, {c for c, found in zip(longs, large) if found})
        for action in stage:
            if action.method in DEDUPLICATE:
                current = current.select(*[col(c) for c in columns])
            current = _rewrite(current, action, stat, rules, kinds)
        current = current.select(*[col(c) for c in columns if c in current.columns])
        if stage is not stages[-1] and any(a.method in DEDUPLICATE for a in stage):
            current = materialize(current)
    return current


def compare_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, missing cells and duplicates of both tables, one row per phase."""
    from dqengine.operators.profile import missing_cells

    def one(df: DataFrame, phase: str) -> DataFrame:
        return df.agg(F.count("*").alias("total_rows")).select(
            F.lit(phase).alias("phase"),
            "total_rows",
            missing_cells(df).scalar().alias("missing_cells"),
            duplicate_count(nan_to_null(df)).scalar().alias("duplicates"),
        )

    return one(before, "before").unionByName(one(after, "after"))
