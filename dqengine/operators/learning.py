"""Learning history: patterns, recommendations and feedback, derived from append-only logs.

Nothing here updates a pattern row by row. Patterns are aggregates of the outcome log,
and feedback acts on them through sums, so every step combines before it shuffles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqengine.schemas import SeverityThresholds
from dqengine.session import materialize

# Limits, weights and word lists of the learning rules.
CONFIDENT = 0.3
SUCCESSFUL = 0.7
DEFAULT_CONFIDENCE = 0.5
FULL_CONFIDENCE_ATTEMPTS = 10
FEEDBACK_DAYS = 30
REJECTION_DAYS = 60
PATTERN_DAYS = 60
HISTORY_DAYS = 90
FEEDBACK_KEYWORDS = ("median", "mean", "conservative", "aggressive", "careful")
ALTERNATIVE_METHODS = (
    "FILL_MEAN",
    "FILL_MEDIAN",
    "FILL_MODE",
    "FILL_FORWARD",
    "FILL_BACKWARD",
    "DROP_ROWS",
    "DROP_COLUMNS",
    "OUTLIER_IQR",
    "OUTLIER_ZSCORE",
    "DUPLICATE_REMOVE",
    "DUPLICATE_KEEP_FIRST",
)
REJECTION_REASONS = {
    "too aggressive": "too_aggressive",
    "too conservative": "too_conservative",
    "wrong method": "wrong_method",
    "data loss": "data_loss_concern",
    "accuracy": "accuracy_concern",
    "manual review": "needs_manual_review",
}
QUALITY_FOCUS = ("completeness", "consistency", "validity")


def _moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _within(column: str, as_of: str, days: int) -> Column:
    start = _moment(as_of) - F.expr(f"interval {days} days")
    return (F.col(column) >= start) & (F.col(column) <= _moment(as_of))


def outcome_rows(results: DataFrame) -> DataFrame:
    """Outcome-log rows from results with a boolean ``success``."""
    return results.withColumns(
        {
            "outcome": F.when(F.col("success"), "SUCCESS").otherwise("FAILED"),
            "success_score": F.when(F.col("success"), 1.0).otherwise(0.0),
        }
    ).drop("success")


def _attempt_confidence(attempts: Column) -> Column:
    return F.least(attempts / float(FULL_CONFIDENCE_ATTEMPTS), F.lit(1.0))


def learning_patterns(log: DataFrame) -> DataFrame:
    """Attempts, successes, rate and confidence per agent and pattern (action and context)."""
    return (
        log.groupBy("agent_name", F.concat_ws("_", "action_type", "context").alias("pattern"))
        .agg(
            F.min("action_type").alias("action_type"),
            F.min("context").alias("context"),
            F.count("*").alias("attempts"),
            F.count_if(F.col("success_score") == 1.0).alias("successes"),
            F.max("logged_at").alias("last_updated"),
        )
        .select(
            "agent_name",
            "pattern",
            "action_type",
            "context",
            "attempts",
            "successes",
            (F.col("successes") / F.col("attempts")).alias("success_rate"),
            _attempt_confidence(F.col("attempts")).alias("confidence"),
            "last_updated",
        )
    )


def confident_patterns(patterns: DataFrame) -> DataFrame:
    return patterns.where(F.col("confidence") > CONFIDENT)


def successful_patterns(patterns: DataFrame) -> DataFrame:
    """Confident patterns with a high rate, best first within each agent."""
    return (
        confident_patterns(patterns)
        .where(F.col("success_rate") > SUCCESSFUL)
        .orderBy("agent_name", F.desc("success_rate"), F.desc("confidence"), "pattern")
    )


def agent_recommendations(patterns: DataFrame) -> DataFrame:
    """One row per agent: overall confidence and pattern counts."""
    return (
        confident_patterns(patterns)
        .groupBy("agent_name")
        .agg(
            F.least(F.avg("confidence"), F.lit(1.0)).alias("overall_confidence"),
            F.count("*").alias("confident_patterns"),
            F.count_if(F.col("success_rate") > SUCCESSFUL).alias("learned_patterns_count"),
        )
    )


def _successful() -> Column:
    return (F.col("confidence") > CONFIDENT) & (F.col("success_rate") > SUCCESSFUL)


def learned_thresholds(patterns: DataFrame, agent: str = "DataQualityAgent") -> DataFrame:
    """One row of severity limits for profiling, widened by successful null handling."""
    mine = (F.col("agent_name") == agent) & _successful()
    widening = F.count_if(mine & F.col("pattern").contains("null_handling") & (F.col("success_rate") > 0.8))
    financial = F.count_if(
        mine & F.col("pattern").contains("quality_analysis") & (F.col("context") == "financial_data")
    )
    focus = F.concat_ws(
        ",", F.lit(",".join(QUALITY_FOCUS)), F.when(financial > 0, F.lit("accuracy"))
    )
    return patterns.agg(
        F.least(F.lit(20), F.lit(15) + 2 * widening).cast("double").alias("null_high"),
        F.lit(8.0).alias("null_medium"),
        F.lit(10.0).alias("duplicate_high"),
        F.lit(5.0).alias("duplicate_medium"),
        F.lit(5.0).alias("outlier_high"),
        F.lit(2.0).alias("outlier_medium"),
        focus.alias("focus_areas"),
    )


def learned_methods(patterns: DataFrame, agent: str = "DataHealingAgent") -> DataFrame:
    """One row of preferred methods; of the patterns that name one, the weakest decides."""
    mine = (F.col("agent_name") == agent) & _successful()
    choice = F.when(
        mine & F.col("pattern").contains("FILL_MEDIAN") & (F.col("success_rate") > 0.9), "FILL_MEDIAN"
    ).when(mine & F.col("pattern").contains("FILL_MEAN") & (F.col("success_rate") > 0.85), "FILL_MEAN")
    order = F.when(
        choice.isNotNull(), F.struct(-F.col("success_rate"), -F.col("confidence"), F.col("pattern"))
    )
    return patterns.agg(
        F.coalesce(F.max_by(choice, order), F.lit("FILL_MEDIAN")).alias("numeric_nulls"),
        F.lit("FILL_MODE").alias("categorical_nulls"),
        F.lit("KEEP_FIRST").alias("duplicates"),
        F.lit("CAP_OUTLIERS").alias("outliers"),
    )


def learned_auto_approval(patterns: DataFrame, agent: str = "PipelineOrchestrator") -> DataFrame:
    """One row of approval limits, relaxed by successful automatic approvals."""
    mine = (F.col("agent_name") == agent) & _successful()
    proven = F.count_if(mine & F.col("pattern").contains("auto_approved") & (F.col("success_rate") > 0.95))
    return patterns.agg(
        F.least(F.lit(0.15), F.lit(0.1) + F.lit(0.02) * proven).alias("auto_approval_threshold"),
        F.lit(85.0).alias("quality_score_threshold"),
        F.lit("HANDLE_NULLS,REMOVE_DUPLICATES").alias("safe_actions"),
        F.lit("HANDLE_OUTLIERS,DELETE_COLUMNS").alias("human_approval_needed"),
    )


@dataclass(frozen=True)
class Learned:
    """What profiling and planning take from the history, as plain values."""

    limits: SeverityThresholds
    confidence: float
    methods: tuple[str, ...]


def learned_inputs(patterns: DataFrame, planner: str = "DataHealingAgent") -> Learned:
    """Limits, planning confidence (0.5 without confident patterns) and preferred methods.

    Reads three one-row results; the patterns are scanned once for each.
    """
    limits = learned_thresholds(patterns).drop("focus_areas").first().asDict()
    sure = agent_recommendations(patterns.where(F.col("agent_name") == planner)).first()
    methods = learned_methods(patterns, planner).first()
    return Learned(
        SeverityThresholds(**limits),
        sure["overall_confidence"] if sure else DEFAULT_CONFIDENCE,
        tuple(methods),
    )


def store_feedback(feedback: DataFrame, path: str) -> None:
    """Append human feedback to its log; ratings outside 1 to 5 are brought to the nearer end."""
    rating = F.greatest(F.lit(1), F.least(F.lit(5), F.col("rating"))).cast(feedback.schema["rating"].dataType)
    known = F.when(F.col("rating").isNotNull(), rating)
    feedback.withColumn("rating", known).write.mode("append").parquet(path)


def parsed_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback with the method, target and severity its text hints at."""
    text = F.lower(F.coalesce("feedback_text", F.lit("")))

    def says(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [text.contains(w) for w in words])

    method = (
        F.when(says("median"), "FILL_MEDIAN")
        .when(says("mean", "average"), "FILL_MEAN")
        .when(says("mode", "most common"), "FILL_MODE")
    )
    target = (
        F.when(says("outlier", "cap"), "outliers")
        .when(says("null", "missing", "nan"), "nulls")
        .when(says("duplicate"), "duplicates")
    )
    hint = F.when(says("high", "severe"), "HIGH").when(says("low", "minor"), "LOW")
    return feedback.withColumns(
        {"suggested_method": method, "target": target, "severity_hint": hint}
    )


def pattern_updates(feedback: DataFrame) -> DataFrame:
    """Multipliers ``(agent_name, context, at, action_id, part, ln_m)`` that feedback implies.

    Ratings of 4 and more strengthen by 1.1, of 2 and less weaken by 0.9. Parsed free text
    acts a second time (1.05 or 0.9), on its target if it has no context.
    """
    rating = F.col("rating")
    own = F.coalesce("context", F.lit(""))
    first = F.when(rating >= 4, math.log(1.1)).when(rating <= 2, math.log(0.9))
    second = F.when(
        F.col("feedback_type") == "nlp_parsed",
        F.when(rating >= 4, math.log(1.05)).when(rating <= 2, math.log(0.9)),
    )
    aim = F.when(own != "", own).otherwise(F.col("target"))
    parts = F.array(
        F.struct(own.alias("context"), F.lit(1).alias("part"), first.alias("ln_m")),
        F.struct(aim.alias("context"), F.lit(2).alias("part"), second.alias("ln_m")),
    )
    return (
        parsed_feedback(feedback)
        .select("agent_name", "action_id", F.col("feedback_at").alias("at"), F.inline(parts))
        .where("ln_m is not null and context is not null")
    )


#: Lengths of the pieces of pattern names by which contexts find them; a context looks for the longest it fills.
GRAMS = (1, 2, 4, 8)


def context_matches(names: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(agent_name, pattern, context)`` where the name of the pattern contains the context.

    Every name is indexed by its pieces of a few fixed lengths, and a context by the first such piece of its own; what
    shares one is compared. The empty context is the empty piece, which every name has once.
    """
    pattern, context = F.col("pattern"), F.col("context")

    def pieces(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(pattern) - (n - 1))
        return F.when(F.length(pattern) >= n, F.transform(starts, lambda i: F.substring(pattern, i, F.lit(n))))

    every = F.array_distinct(F.flatten(F.array_compact(F.array(F.array(F.lit("")), *map(pieces, GRAMS)))))
    index = names.select("agent_name", "pattern", F.explode(every).alias("piece"))
    fills = F.lit("")
    for n in GRAMS:
        fills = F.when(F.length(context) >= n, F.left(context, F.lit(n))).otherwise(fills)
    wanted = contexts.select("agent_name", "context", fills.alias("piece"))
    found = index.join(wanted, ["agent_name", "piece"]).where(F.contains(pattern, context))
    return found.select("agent_name", "pattern", "context")


def run_effects(steps: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """For each run of logarithms their sum ``total``, and the largest sum ``peak`` of a leading part.

    The pairs (sum, largest leading sum) of neighbouring parts of a run combine to that of both. All steps are put in
    order over all tasks, so a run may lie in many of them; each task forms the pairs of its own parts, and the few
    pairs of a run are combined in order.
    """
    every = [*keys, *order, value]
    placed = steps.select(*every).repartitionByRange(*every).withColumn("__part", F.spark_partition_id())
    placed = materialize(placed, "runs")
    inside = Window.partitionBy("__part", *keys).orderBy(*order, value).rowsBetween(Window.unboundedPreceding, 0)
    parts = (
        placed.withColumn("__run", F.sum(value).over(inside))
        .groupBy("__part", *keys)
        .agg(F.sum(value).alias("__sum"), F.max("__run").alias("__peak"))
    )
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("__start", F.coalesce(F.sum("__sum").over(earlier), F.lit(0.0)))
        .groupBy(*keys)
        .agg(F.sum("__sum").alias("total"), F.max(F.col("__start") + F.col("__peak")).alias("peak"))
    )


def reinforced_patterns(patterns: DataFrame, feedback: DataFrame) -> DataFrame:
    """Patterns after all feedback whose context their name contains.

    The rate is multiplied freely; the confidence is cut at 1 after every step. A run of
    steps ``c -> min(1, c * m)`` equals ``min(c * A, A / P)``, where ``A`` is the product of
    all multipliers and ``P`` the largest product of a leading part of the run. Both come
    from ``run_effects`` over logarithms, so no run of feedback is gathered in one task.
    Patterns that the same contexts meet share one history, named by two hashes over its
    contexts.
    """
    updates = materialize(pattern_updates(feedback), "updates")
    contexts = updates.select("agent_name", "context").distinct()
    names = patterns.select("agent_name", "pattern").distinct()
    matches = materialize(context_matches(names, contexts), "matches")
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "context")).alias(f"__h{seed}") for seed in (1, 2)]
    histories = matches.groupBy("agent_name", "pattern").agg(*marks)
    keys = ["agent_name", "__h1", "__h2"]
    first = histories.groupBy(*keys).agg(F.min("pattern").alias("pattern"))
    shared = matches.join(first, ["agent_name", "pattern"]).select(*keys, "context")
    steps = updates.join(shared, ["agent_name", "context"])
    effects = run_effects(steps, keys, ["at", "action_id", "part"], "ln_m")
    effect = histories.join(effects, keys).select("agent_name", "pattern", "total", "peak")
    product = F.exp("total")
    return patterns.join(effect, ["agent_name", "pattern"], "left").select(
        "agent_name",
        "pattern",
        F.coalesce(F.col("success_rate") * product, F.col("success_rate")).alias("success_rate"),
        F.coalesce(
            F.least(F.col("confidence") * product, F.exp(F.col("total") - F.col("peak"))),
            F.col("confidence"),
        ).alias("confidence"),
    )


def feedback_by_type(feedback: DataFrame, as_of: str, days: int = FEEDBACK_DAYS) -> DataFrame:
    """Rating, count, weak spots and keywords per agent and feedback type.

    Keywords are whole words of a text. They are looked up per text and combined as flags;
    the texts of a type are never joined into one string.
    """
    words = F.split(F.lower("feedback_text"), r"\s+")
    flags = [
        F.bool_or(F.array_contains(words, w)).alias(f"__w{i}") for i, w in enumerate(FEEDBACK_KEYWORDS)
    ]
    said = [F.when(F.col(f"__w{i}"), w) for i, w in enumerate(FEEDBACK_KEYWORDS)]
    return (
        feedback.where(_within("feedback_at", as_of, days))
        .groupBy("agent_name", "feedback_type")
        .agg(F.avg(F.col("rating").cast("double")).alias("avg_rating"), F.count("*").alias("feedback_count"), *flags)
        .select(
            "agent_name",
            "feedback_type",
            "avg_rating",
            "feedback_count",
            (F.col("avg_rating") < 3.0).alias("needs_improvement"),
            F.concat_ws(",", *said).alias("common_suggestions"),
        )
    )


def feedback_overview(feedback: DataFrame, as_of: str, days: int = FEEDBACK_DAYS) -> DataFrame:
    """One row per agent: satisfaction weighted by count, and the types below 3."""
    weighted = F.sum(F.col("avg_rating") * F.col("feedback_count")) / F.sum("feedback_count")
    return (
        feedback_by_type(feedback, as_of, days)
        .groupBy("agent_name")
        .agg(
            weighted.alias("overall_satisfaction"),
            F.sum("feedback_count").alias("feedback_count"),
            F.array_join(
                F.array_sort(F.collect_list(F.when(F.col("needs_improvement"), F.col("feedback_type")))),
                ",",
            ).alias("improvement_areas"),
        )
    )


def _rejections(actions: DataFrame, feedback: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rejected actions with counts of what their feedback mentions.

    Feedback is summed per action before the join, so an action with much feedback is no
    hot key, and the join is one to one.
    """
    text = F.lower(F.coalesce("feedback_text", F.lit("")))
    mentions = [
        F.count_if(text.contains(m.lower())).alias(f"__m{i}") for i, m in enumerate(ALTERNATIVE_METHODS)
    ] + [F.count_if(text.contains(k)).alias(f"__r{i}") for i, k in enumerate(REJECTION_REASONS)]
    said = feedback.groupBy("action_id").agg(F.count("*").alias("__rows"), *mentions)
    rejected = actions.where(
        (F.col("agent_name") == "HumanOperator")
        & F.col("action_type").contains("REJECTED")
        & _within("action_at", as_of, days)
    ).select("action_id", "action_type")
    return rejected.join(said, "action_id", "left").withColumn("__rows", F.coalesce("__rows", F.lit(1)))


def rejected_actions(
    actions: DataFrame, feedback: DataFrame, as_of: str, days: int = REJECTION_DAYS
) -> DataFrame:
    """Rejections per action type, raw and reduced to the bare action name."""
    bare = F.regexp_replace("action_type", "^(BULK_)?REJECTED_(WITH_ALTERNATIVE_)?", "")
    return (
        _rejections(actions, feedback, as_of, days)
        .groupBy(F.col("action_type").alias("raw_action"), bare.alias("rejected_action"))
        .agg(F.sum("__rows").alias("rejections"))
    )


def _mention_counts(rejections: DataFrame, prefix: str, labels: list[str], name: str) -> DataFrame:
    sums = rejections.agg(*[F.sum(f"{prefix}{i}").alias(f"{prefix}{i}") for i in range(len(labels))])
    entries = [
        F.struct(F.lit(label).alias(name), F.col(f"{prefix}{i}").alias("mentions"))
        for i, label in enumerate(labels)
    ]
    return sums.select(F.inline(F.array(*entries))).where("mentions > 0")


def preferred_alternatives(
    actions: DataFrame, feedback: DataFrame, as_of: str, days: int = REJECTION_DAYS
) -> DataFrame:
    """How often feedback on rejections names each method."""
    found = _rejections(actions, feedback, as_of, days)
    return _mention_counts(found, "__m", list(ALTERNATIVE_METHODS), "method")


def rejection_reasons(
    actions: DataFrame, feedback: DataFrame, as_of: str, days: int = REJECTION_DAYS
) -> DataFrame:
    """How often feedback on rejections gives each reason."""
    found = _rejections(actions, feedback, as_of, days)
    return _mention_counts(found, "__r", list(REJECTION_REASONS.values()), "reason")


def rejection_insights(
    actions: DataFrame, feedback: DataFrame, as_of: str, days: int = REJECTION_DAYS
) -> DataFrame:
    """One sentence each on the most rejected action and the most named alternative."""
    rejected = (
        rejected_actions(actions, feedback, as_of, days)
        .groupBy("rejected_action")
        .agg(F.sum("rejections").alias("n"))
        .select(
            F.lit("Most frequently rejected action: ").alias("lead"), F.col("rejected_action").alias("name"), "n"
        )
    )
    named = preferred_alternatives(actions, feedback, as_of, days).select(
        F.lit("Most preferred alternative: ").alias("lead"),
        F.col("method").alias("name"),
        F.col("mentions").alias("n"),
    )
    order = F.struct(-F.col("n"), F.col("name"))
    top = rejected.unionByName(named).groupBy("lead").agg(
        F.min_by("name", order).alias("name"), F.max("n").alias("n")
    )
    return top.select(
        F.concat("lead", "name", F.lit(" ("), F.col("n").cast("string"), F.lit(" times)")).alias("insight")
    )


def top_rejections(rejected: DataFrame, n: int = 3) -> DataFrame:
    return (
        rejected.groupBy("rejected_action")
        .agg(F.sum("rejections").alias("rejections"))
        .orderBy(F.desc("rejections"), "rejected_action")
        .limit(n)
        .select(
            F.initcap(F.translate("rejected_action", "_", " ")).alias("rejected_action"), "rejections"
        )
    )


def top_alternatives(alternatives: DataFrame, n: int = 3) -> DataFrame:
    return alternatives.orderBy(F.desc("mentions"), "method").limit(n)


def learning_history(log: DataFrame, as_of: str, days: int = HISTORY_DAYS) -> DataFrame:
    """Rate, count and confidence per agent and action."""
    return (
        log.where(_within("logged_at", as_of, days))
        .groupBy("agent_name", "action_type")
        .agg(F.avg("success_score").alias("success_rate"), F.count("*").alias("action_count"))
        .withColumn("confidence", _attempt_confidence(F.col("action_count")))
    )


def success_rates(log: DataFrame, agents: DataFrame, as_of: str, days: int = FEEDBACK_DAYS) -> DataFrame:
    """Success in percent per agent; 100 without any action."""
    rates = (
        log.where(_within("logged_at", as_of, days))
        .groupBy("agent_name")
        .agg((F.avg("success_score") * 100.0).alias("success_rate"))
    )
    return agents.select("agent_name").join(rates, "agent_name", "left").fillna(100.0, ["success_rate"])


def action_counts(log: DataFrame, agents: DataFrame, as_of: str, days: int = FEEDBACK_DAYS) -> DataFrame:
    counts = (
        log.where(_within("logged_at", as_of, days))
        .groupBy("agent_name")
        .agg(F.count("*").alias("total_actions"))
    )
    return agents.select("agent_name").join(counts, "agent_name", "left").fillna(0, ["total_actions"])


def success_failure_patterns(log: DataFrame, as_of: str, days: int = PATTERN_DAYS) -> DataFrame:
    """Actions tried three times or more that mostly succeed or mostly fail."""
    rate = F.col("success_rate")
    kind = F.when(rate >= 0.8, "success").when(rate <= 0.4, "failure")
    return (
        log.where(_within("logged_at", as_of, days))
        .groupBy("agent_name", "action_type")
        .agg(F.avg("success_score").alias("success_rate"), F.count("*").alias("n"))
        .where("n >= 3")
        .select(
            "agent_name",
            kind.alias("kind"),
            F.format_string("%s (Success: %.1f%%, Count: %d)", "action_type", rate * 100, "n").alias(
                "description"
            ),
        )
        .where("kind is not null")
    )


def learning_summary(log: DataFrame, feedback: DataFrame, agents: DataFrame, as_of: str) -> DataFrame:
    """One row per agent: volume, rate, confidence level, patterns and satisfaction."""
    level = F.when(F.col("total_actions") > 50, "high").when(F.col("total_actions") > 20, "medium")
    kinds = (
        success_failure_patterns(log, as_of)
        .groupBy("agent_name")
        .agg(
            F.count_if(F.col("kind") == "success").alias("successful_patterns"),
            F.count_if(F.col("kind") == "failure").alias("failure_patterns"),
        )
    )
    said = feedback_overview(feedback, as_of).select("agent_name", "overall_satisfaction", "feedback_count")
    return (
        action_counts(log, agents, as_of, HISTORY_DAYS)
        .join(success_rates(log, agents, as_of, HISTORY_DAYS), "agent_name")
        .join(kinds, "agent_name", "left")
        .join(said, "agent_name", "left")
        .withColumn("learning_confidence", F.coalesce(level, F.lit("low")))
        .fillna(0, ["successful_patterns", "failure_patterns", "feedback_count"])
        .fillna(0.0, ["overall_satisfaction"])
    )
