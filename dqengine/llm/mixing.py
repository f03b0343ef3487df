"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its size takes floor(r) whole copies of each of its documents for certain. One more
copy has an inclusion probability of its own for every document: r - floor(r) on average, more for shorter documents
and less for longer ones, so that the expected words are exactly what the target still asks for. Documents are ranked
by random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order; one that does not
fit in what is left is passed over and the ranking goes on. One further document, whose size comes nearest to what is
missing at the end, closes the gap if that brings the words nearer to the target. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqengine.llm.common import word_count
from dqengine.session import materialize

#: Bins of the rank in which words are summed before one bin of each source is looked at closely.
BINS = 4096


def _random(id_column: Column, seed: int) -> Column:
    """A number inside (0, 1) from the MD5 of seed and id: the same in every run and in every engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("null")))
    number = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (number + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, most_copies: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source with its size.

    Sources by code point, null last, weigh ``weights``, repeated. The whole size is shared by weight; no target
    exceeds ``most_copies`` times its source's size, and what is over is shared again by weight. That is the level L
    with min(cap, L * weight) adding up to the whole, found in one pass over the sources in order of cap / weight.
    The table has one row per source, which is why its windows need no keys.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), number)).withColumn(
        "cap", F.col("source_size") * most_copies
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    # The first source, in this order, that its share does not fill fixes the level for itself and all later ones.
    first_open = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("place", "level"))
    return (
        ranked.withColumn("place", F.row_number().over(filling))
        .withColumn("level", level)
        .withColumn("final", F.min(first_open).over(everything)["level"])
        .withColumn("cap", F.col("cap").cast("double"))
        .select(
            "source",
            "source_size",
            F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap")).alias("target"),
        )
    )


def _rank(u: Column, p: Column, preference: Column) -> Column:
    """Random odds over inclusion odds, brought into (0, 1) without changing their order; null if p is 0."""
    ratio = F.try_divide(u / (F.lit(1.0) - u), p / (F.lit(1.0) - p) * preference)
    return ratio / (F.lit(1.0) + ratio)


def _prepared(
    docs: DataFrame, id_column: str, text_column: str, source_column: str, preference_column: str | None
) -> DataFrame:
    preference = F.col(f"`{preference_column}`").cast("double") if preference_column else F.lit(1.0)
    return docs.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        F.col(f"`{source_column}`").alias("source"),
        word_count(F.col(f"`{text_column}`")).alias("size"),
        F.when(preference > 0, preference).otherwise(F.lit(1.0)).alias("preference"),
    )


def _joined(rows: DataFrame, plan: DataFrame, source: str = "source") -> DataFrame:
    """Rows with their source's line of the plan. The plan has one row per source, so Spark may broadcast it if small."""
    renamed = plan.withColumnRenamed("source", "_source")
    return rows.join(renamed, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")


def _shares(units: DataFrame, most_copies: int, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: sizes, target, certain copies, and what the inclusion probabilities follow from.

    A document of ``size`` words has the weight x = mean / (mean + size), between 0 and 1. With ``centre``, the mean
    of x over all words, p = p0 + min(p0, 1 - p0) * (x - centre) lies between 0 and 1, and the words times p add up to
    p0 times all words.
    """
    sizes = units.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("documents"))
    mean = F.col("source_size") / F.col("documents")
    sizes = materialize(sizes.withColumn("mean", mean), "mix-sources")
    weighted = _joined(units.select("source", "size", "words"), sizes.select("source", "mean"))
    centres = weighted.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("words") * _weight()).alias("sum"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    found = (
        _joined(targets(sizes.select("source", "source_size"), most_copies, weights), sizes.select("source", "mean"))
        .join(centres, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("copies", F.floor(ratio).cast("int"))
        .withColumn("p0", ratio - F.floor(ratio))
        .withColumn("rest", F.col("p0") * F.col("source_size"))
        .withColumn("centre", F.try_divide("sum", "source_size"))
    )
    return materialize(found.drop("_s", "sum"), "mix-targets")


def _weight() -> Column:
    return F.when(F.col("mean") > 0, F.col("mean") / (F.col("mean") + F.col("size"))).otherwise(F.lit(0.0))


def _ranked(rows: DataFrame, seed: int) -> DataFrame:
    """Rows (``doc_id``, ``size``, ``preference``, and the columns of their source's share) with their ``rank``."""
    p = F.col("p0") + F.least(F.col("p0"), 1 - F.col("p0")) * (_weight() - F.col("centre"))
    return rows.withColumn("rank", _rank(_random(F.col("doc_id"), seed), p, F.col("preference")))


def _cuts(ranked: DataFrame, open_sources: DataFrame) -> DataFrame:
    """``source``, ``cut`` (the first rank that would pass the gap; null: all fit) and what is ``left`` of it.

    ``ranked`` has ``source``, ``rank`` and ``words``, ``open_sources`` has ``source`` and ``gap``. Words are summed in
    bins of the rank first, so only the one bin of each source with the cut is ever sorted.
    """
    rows = _joined(ranked, open_sources.select("source", "gap")).withColumn("bin", F.floor(F.col("rank") * BINS).cast("int"))
    along = Window.partitionBy("source").orderBy("bin")
    bins = (
        rows.groupBy("source", "bin")
        .agg(F.sum("words").alias("words"), F.max("gap").alias("gap"))
        .withColumn("upto", F.sum("words").over(along))
    )
    totals = bins.groupBy("source").agg(
        F.max("gap").alias("gap"),
        F.max("upto").alias("all"),
        F.min(F.when(F.col("upto") > F.col("gap"), F.struct("bin", (F.col("upto") - F.col("words")).alias("before")))).alias("at"),
    )
    totals = materialize(totals, "mix-bins")
    inside = Window.partitionBy("source").orderBy("rank")
    cut = (
        _joined(rows.drop("gap"), totals.filter("at is not null").select("source", "gap", "at"))
        .filter(F.col("bin") == F.col("at.bin"))
        .groupBy("source", "rank")
        .agg(F.sum("words").alias("words"), F.max("gap").alias("gap"), F.max("at.before").alias("before"))
        .withColumn("upto", F.col("before") + F.sum("words").over(inside))
        .filter(F.col("upto") > F.col("gap"))
        .groupBy("source")
        .agg(F.min(F.struct("rank", (F.col("gap") - (F.col("upto") - F.col("words"))).alias("left"))).alias("cut"))
    )
    whole = totals.filter("at is null").select(
        "source", F.lit(None).cast("double").alias("cut"), (F.col("gap") - F.col("all")).alias("left")
    )
    return materialize(cut.select("source", "cut.rank", "cut.left").toDF("source", "cut", "left").union(whole), "mix-cuts")


def sampling_plan(
    units: DataFrame, most_copies: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 42
) -> DataFrame:
    """One row per source: its share, the ``spans`` of the ranking that are taken, and the rank that closes the gap.

    ``units`` has ``source``, ``doc_id``, ``size``, ``preference``, ``n`` (rows that are alike) and ``words`` of all n.
    A unit is taken if it lies inside a span and has no more words than the span allows. The first span ends at the
    first unit that does not fit; the next one starts there and takes units that fit in what is left, and so on. What
    is left halves at least from span to span, so there are few.
    """
    shares = _shares(units, most_copies, weights)
    ranked = _ranked(_joined(units, shares.filter("p0 > 0").select("source", "p0", "mean", "centre", "rest")), seed)
    ranked = materialize(ranked.select("source", "rank", "words"), "mix-ranks")
    state = shares.filter("p0 > 0").select("source", F.col("rest").alias("gap"), F.lit(-1.0).alias("after"))
    spans, rest, candidates = None, None, ranked
    while True:
        found = _cuts(candidates, state)
        most = F.when(F.col("after") >= 0, F.col("gap")).otherwise(F.lit(float("inf")))
        ended = _joined(state, found).select(
            "source", "after", F.coalesce("cut", F.lit(2.0)).alias("until"), most.alias("most"), "left", "cut"
        )
        ended = materialize(ended, "mix-spans")
        spans = ended if spans is None else materialize(spans.union(ended), "mix-spans")
        state = ended.filter("cut is not null and left >= 1").select("source", F.col("left").alias("gap"), F.col("cut").alias("after"))
        candidates = _joined(candidates, state).filter("rank > after and 0 < words and words <= gap")
        candidates = materialize(candidates.select("source", "rank", "words"), "mix-ranks")
        if candidates.isEmpty():
            break
        # Sources for which nothing more fits have no further span.
        state = state.join(candidates.select(F.col("source").alias("_c")).distinct(), F.col("source").eqNullSafe(F.col("_c")), "left_semi")
    span = F.struct("after", "until", "most")
    taken = spans.groupBy(F.col("source").alias("_s")).agg(
        F.sort_array(F.collect_list(span)).alias("spans"), F.min("left").alias("left"), F.min("cut").alias("first_cut")
    )
    plan = shares.join(taken, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    plan = materialize(plan, "mix-plan")
    # Of what was passed over, the one that comes nearest to the words that are missing.
    others = _joined(ranked, plan.filter("first_cut is not null").select("source", "spans", "left", "first_cut"))
    others = others.filter((F.col("rank") >= F.col("first_cut")) & ~_inside())
    closing = others.groupBy(F.col("source").alias("_s")).agg(
        F.min(F.struct(F.abs(F.col("words") - F.col("left")).alias("off"), "rank")).alias("fit"), F.max("left").alias("l")
    )
    extra = closing.filter("fit.off < l").select("_s", F.col("fit.rank").alias("extra"))
    return materialize(plan.join(extra, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-plan")


def _inside() -> Column:
    """Whether a unit (``rank``, ``words``) lies in one of the ``spans`` of its source."""
    rank, words = F.col("rank"), F.col("words")
    return F.exists(
        "spans",
        lambda s: (rank > s["after"]) & (rank < s["until"]) & (words <= s["most"]) & ((words > 0) | (s["after"] < 0)),
    )


def _copies() -> Column:
    sampled = (F.col("p0") > 0) & (F.coalesce(_inside(), F.lit(False)) | F.coalesce(F.col("rank") == F.col("extra"), F.lit(False)))
    return F.col("copies") + F.when(sampled, 1).otherwise(0)


def _units(prepared: DataFrame) -> DataFrame:
    """Rows that are alike in source, id, size and preference are ranked and taken together."""
    units = prepared.groupBy("source", "doc_id", "size", "preference").agg(F.count("*").alias("n"))
    return materialize(units.withColumn("words", F.col("size") * F.col("n")), "mix-units")


def allocate(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    preference_column: str | None = None, most_copies: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 42,
) -> DataFrame:
    """Per document ``doc_id``, ``size`` (words), ``source_size``, ``target`` (its source's words), ``taken``, ``source``, ``copies``.

    A null text has size 0. Documents without a source form one, which comes last. Rows with the same id and size
    rank alike and are taken or left together; repeated rows come out as often as they went in.
    ``preference_column`` multiplies the inclusion odds; missing or not positive values count as 1. An empty table
    gives an empty result.
    """
    units = _units(_prepared(docs, id_column, text_column, source_column, preference_column))
    rows = _ranked(_joined(units, sampling_plan(units, most_copies, weights, seed)), seed)
    return (
        rows.withColumn("copies", _copies())
        .withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .select(
            "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
        )
    )


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    preference_column: str | None = None, most_copies: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 42,
) -> DataFrame:
    """The documents of the mix, in the columns of ``docs``, each as often as it is taken; see ``allocate``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    units = _units(_prepared(docs, id_column, text_column, source_column, preference_column))
    plan = sampling_plan(units, most_copies, weights, seed)
    preference = F.col(f"row.`{preference_column}`").cast("double") if preference_column else F.lit(1.0)
    rows = docs.select(row).select(
        "row",
        F.col("row")[id_column].alias("doc_id"),
        F.col("row")[source_column].alias("source"),
        word_count(F.col("row")[text_column].cast("string")).alias("size"),
        F.when(preference > 0, preference).otherwise(F.lit(1.0)).alias("preference"),
    )
    rows = _joined(rows, plan)
    alike = units.filter("n > 1")
    if alike.isEmpty():
        rows = rows.withColumn("words", F.col("size"))
    else:
        keys = ("source", "doc_id", "size", "preference")
        alike = alike.select(*[F.col(k).alias(f"_{k}") for k in keys], "words")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        rows = rows.join(alike, same, "left").withColumn("words", F.coalesce("words", "size"))
    return (
        _ranked(rows, seed)
        .withColumn("times", F.explode(F.array_repeat(F.lit(1), _copies())))
        .select(*[F.col("row")[c].alias(c) for c in docs.columns])
    )
