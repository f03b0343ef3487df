import itertools
import random
from datetime import datetime, timedelta

import pytest

from dqengine.operators import learning as L

START = datetime(2024, 1, 1)
NOW = "2024-01-31 00:00:00"
FEEDBACK = (
    "action_id long, agent_name string, feedback_type string, feedback_text string, rating int, "
    "context string, feedback_at timestamp_ntz"
)
PATTERN = "agent_name string, pattern string, success_rate double, confidence double"
LOG = "agent_name string, action_type string, context string, success_score double, logged_at timestamp_ntz"


def _target(text):
    text = (text or "").lower()
    found = None
    if "duplicate" in text:
        found = "duplicates"
    if any(w in text for w in ("null", "missing", "nan")):
        found = "nulls"
    if any(w in text for w in ("outlier", "cap")):
        found = "outliers"
    return found


def test_reinforcement_equals_step_by_step_updates(spark):
    rng = random.Random(4)
    patterns = [
        (agent, f"{action}_{ctx}", rng.random(), rng.choice([0.1, 0.6, 1.0]))
        for agent in ("A", "B")
        for action in ("fill_nulls", "drop_outliers", "dedupe_duplicates")
        for ctx in ("set_1", "set_10", "set_2", "")
    ]
    feedback = [
        (
            i,
            rng.choice(["A", "B", "C"]),
            rng.choice(["general", "nlp_parsed"]),
            rng.choice(["missing values", "cap the outlier", "duplicate rows", "fine", None]),
            rng.randint(1, 5),
            rng.choice(["set_1", "set_2", "set_10", "", None, "elsewhere"]),
            START + timedelta(minutes=17 * rng.randrange(2000)),
        )
        for i in range(300)
    ]
    state = {(a, p): [r, c] for a, p, r, c in patterns}

    def act(agent, context, m):
        for (a, p), value in state.items():
            if a == agent and context in p:
                value[0] *= m
                value[1] = min(1.0, value[1] * m)

    for i, agent, kind, text, rating, context, _ in sorted(feedback, key=lambda f: (f[6], f[0])):
        if rating == 3:
            continue
        act(agent, context or "", 1.1 if rating >= 4 else 0.9)
        if kind == "nlp_parsed":
            aim = context or _target(text)
            if aim is not None:
                act(agent, aim, 1.05 if rating >= 4 else 0.9)

    result = L.reinforced_patterns(
        spark.createDataFrame(patterns, PATTERN), spark.createDataFrame(feedback, FEEDBACK)
    ).collect()
    assert len(result) == len(patterns)
    for r in result:
        rate, confidence = state[(r["agent_name"], r["pattern"])]
        assert r["success_rate"] == pytest.approx(rate, rel=1e-9)
        assert r["confidence"] == pytest.approx(confidence, rel=1e-9)


def test_contexts_find_names_that_contain_them(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abc_") for _ in range(n))
    names = {text(rng.randint(0, 14)) for _ in range(60)}
    contexts = {text(rng.randint(0, 10)) for _ in range(60)} | {""}
    got = L.context_matches(
        spark.createDataFrame([("A", n) for n in names], "agent_name string, pattern string"),
        spark.createDataFrame([(a, c) for a in "AB" for c in contexts], "agent_name string, context string"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(("A", n, c) for n in names for c in contexts if c in n)


def test_runs_over_many_parts(spark):
    rng = random.Random(5)
    steps = [(rng.choice("ab") if i % 10 else "c", i, rng.uniform(-1, 1)) for i in range(3000)]
    df = spark.createDataFrame(steps, "k string, at long, v double").repartition(6)
    got = {r["k"]: (r["total"], r["peak"]) for r in L.run_effects(df, ["k"], ["at"], "v").collect()}
    for key in "abc":
        run = list(itertools.accumulate(v for k, _, v in steps if k == key))
        assert got[key] == (pytest.approx(run[-1]), pytest.approx(max(run)))


def test_no_feedback_changes_nothing(spark):
    patterns = spark.createDataFrame([("A", "x_y", 0.5, 0.7)], PATTERN)
    empty = spark.createDataFrame([], FEEDBACK)
    assert tuple(L.reinforced_patterns(patterns, empty).first()) == ("A", "x_y", 0.5, 0.7)


def _log(spark, *entries):
    rows = [(a, t, c, s, START + timedelta(days=d)) for a, t, c, s, n, d in entries for _ in range(n)]
    return spark.createDataFrame(rows, LOG)


def test_patterns_and_recommendations(spark):
    log = _log(
        spark,
        ("A", "null_handling", "x", 1.0, 9, 1), ("A", "null_handling", "x", 0.0, 1, 1),
        ("A", "null_handling", "y", 1.0, 3, 1), ("A", "other", "x", 1.0, 20, 1), ("A", "bad", "x", 0.0, 5, 1),
    )
    patterns = L.learning_patterns(log)
    by_name = {r["pattern"]: r for r in patterns.collect()}
    assert by_name["null_handling_x"]["success_rate"] == 0.9
    assert by_name["null_handling_x"]["confidence"] == 1.0
    assert by_name["null_handling_y"]["confidence"] == 0.3  # not above the limit
    row = L.agent_recommendations(patterns).first()
    assert (row["confident_patterns"], row["learned_patterns_count"]) == (3, 2)
    assert row["overall_confidence"] == pytest.approx((1.0 + 1.0 + 0.5) / 3)
    assert L.learned_thresholds(patterns, "A").first()["null_high"] == 17.0
    assert L.learned_thresholds(patterns, "nobody").first()["null_high"] == 15.0


def _patterns(spark, *rows):
    full = [(a, p, p.rsplit("_", 1)[0], p.rsplit("_", 1)[1], r, c) for a, p, r, c in rows]
    return spark.createDataFrame(
        full, "agent_name string, pattern string, action_type string, context string, success_rate double, confidence double"
    )


def test_learned_limits_are_capped(spark):
    nulls = _patterns(spark, *[("DataQualityAgent", f"null_handling_c{i}", 0.9, 1.0) for i in range(6)])
    assert L.learned_thresholds(nulls).first()["null_high"] == 20.0
    autos = _patterns(spark, *[("PipelineOrchestrator", f"auto_approved_c{i}", 0.99, 1.0) for i in range(5)])
    assert L.learned_auto_approval(autos).first()["auto_approval_threshold"] == pytest.approx(0.15)
    assert L.learned_auto_approval(nulls).first()["auto_approval_threshold"] == pytest.approx(0.10)


def test_weakest_matching_pattern_decides(spark):
    agent = "DataHealingAgent"
    mean_last = _patterns(spark, (agent, "FILL_MEDIAN_a", 0.99, 1.0), (agent, "FILL_MEAN_a", 0.9, 1.0))
    assert L.learned_methods(mean_last).first()["numeric_nulls"] == "FILL_MEAN"
    median_last = _patterns(spark, (agent, "FILL_MEDIAN_a", 0.92, 1.0), (agent, "FILL_MEAN_a", 0.99, 1.0))
    assert L.learned_methods(median_last).first()["numeric_nulls"] == "FILL_MEDIAN"
    too_weak = _patterns(spark, (agent, "FILL_MEAN_a", 0.85, 1.0))
    assert L.learned_methods(too_weak).first()["numeric_nulls"] == "FILL_MEDIAN"


@pytest.mark.parametrize(
    "text,method,target,hint",
    [
        ("Median, not MEAN", "FILL_MEDIAN", None, None),
        ("the average of missing duplicate rows", "FILL_MEAN", "nulls", None),
        ("cap it, HIGH and low", None, "outliers", "HIGH"),
        ("most common value, minor", "FILL_MODE", None, "LOW"),
        (None, None, None, None),
    ],
)
def test_feedback_parsing(spark, text, method, target, hint):
    df = spark.createDataFrame([(text,)], "feedback_text string")
    row = L.parsed_feedback(df).first()
    assert (row["suggested_method"], row["target"], row["severity_hint"]) == (method, target, hint)


def test_feedback_analysis_keeps_to_its_days(spark):
    rows = [
        (1, "A", "t1", "be careful and conservative", 2, "", datetime(2024, 1, 20)),
        (2, "A", "t1", "carefully median.", 3, "", datetime(2024, 1, 21)),
        (3, "A", "t2", None, 5, "", datetime(2024, 1, 22)),
        (4, "A", "t2", "median", 1, "", datetime(2023, 12, 1)),
    ]
    feedback = spark.createDataFrame(rows, FEEDBACK)
    by_type = {r["feedback_type"]: r for r in L.feedback_by_type(feedback, NOW).collect()}
    assert by_type["t1"]["common_suggestions"] == "conservative,careful"
    assert by_type["t1"]["needs_improvement"] and not by_type["t2"]["needs_improvement"]
    row = L.feedback_overview(feedback, NOW).first()
    assert row["overall_satisfaction"] == pytest.approx(10 / 3) and row["improvement_areas"] == "t1"


def test_rejections_with_several_feedback_rows(spark):
    actions = spark.createDataFrame(
        [
            (1, "HumanOperator", "REJECTED_HANDLE_NULLS", datetime(2024, 1, 10)),
            (2, "HumanOperator", "BULK_REJECTED_WITH_ALTERNATIVE_HANDLE_NULLS", datetime(2024, 1, 11)),
            (3, "HumanOperator", "APPROVED_X", datetime(2024, 1, 11)),
            (4, "Robot", "REJECTED_X", datetime(2024, 1, 11)),
            (5, "HumanOperator", "REJECTED_OLD", datetime(2023, 1, 11)),
        ],
        "action_id long, agent_name string, action_type string, action_at timestamp_ntz",
    )
    feedback = spark.createDataFrame(
        [
            (1, "A", "g", "Too aggressive: use fill_median", 2, "", datetime(2024, 1, 10)),
            (1, "A", "g", "FILL_MEDIAN or FILL_MODE, wrong method", 2, "", datetime(2024, 1, 10)),
            (3, "A", "g", "drop_rows", 2, "", datetime(2024, 1, 10)),
        ],
        FEEDBACK,
    )
    rejected = {r["raw_action"]: (r["rejected_action"], r["rejections"]) for r in L.rejected_actions(actions, feedback, NOW).collect()}
    assert rejected == {
        "REJECTED_HANDLE_NULLS": ("HANDLE_NULLS", 2),
        "BULK_REJECTED_WITH_ALTERNATIVE_HANDLE_NULLS": ("HANDLE_NULLS", 1),
    }
    named = {r["method"]: r["mentions"] for r in L.preferred_alternatives(actions, feedback, NOW).collect()}
    assert named == {"FILL_MEDIAN": 2, "FILL_MODE": 1}
    reasons = {r["reason"]: r["mentions"] for r in L.rejection_reasons(actions, feedback, NOW).collect()}
    assert reasons == {"too_aggressive": 1, "wrong_method": 1}
    texts = {r[0] for r in L.rejection_insights(actions, feedback, NOW).collect()}
    assert "Most frequently rejected action: HANDLE_NULLS (3 times)" in texts


def test_rates_counts_and_summary(spark):
    log = _log(spark, ("A", "x", "c", 1.0, 51, 20), ("B", "x", "c", 0.0, 3, 20), ("B", "y", "c", 1.0, 2, 20))
    agents = spark.createDataFrame([("A",), ("B",), ("idle",)], "agent_name string")
    feedback = spark.createDataFrame([], FEEDBACK)
    rows = {r["agent_name"]: r for r in L.learning_summary(log, feedback, agents, NOW).collect()}
    assert rows["A"]["learning_confidence"] == "high" and rows["A"]["successful_patterns"] == 1
    assert rows["B"]["learning_confidence"] == "low" and rows["B"]["failure_patterns"] == 1
    assert rows["B"]["success_rate"] == 40.0
    assert rows["idle"]["success_rate"] == 100.0 and rows["idle"]["total_actions"] == 0
    text = {r["description"] for r in L.success_failure_patterns(log, NOW).collect()}
    assert text == {"x (Success: 100.0%, Count: 51)", "x (Success: 0.0%, Count: 3)"}


def test_outcome_rows(spark):
    df = spark.createDataFrame([(True,), (False,)], "success boolean")
    assert sorted(map(tuple, L.outcome_rows(df).collect())) == [("FAILED", 0.0), ("SUCCESS", 1.0)]


def test_top_lists(spark):
    df = spark.createDataFrame([("R", "HANDLE_NULLS", 3), ("Q", "REMOVE_X", 1)], "raw_action string, rejected_action string, rejections long")
    assert tuple(L.top_rejections(df, 1).first()) == ("Handle Nulls", 3)


def test_learned_inputs_for_profile_and_plan(spark):
    agent = "DataHealingAgent"
    found = L.learned_inputs(_patterns(spark, (agent, "FILL_MEAN_a", 0.9, 0.8), ("X", "y_z", 0.9, 0.4)))
    assert found.confidence == pytest.approx(0.8)
    assert found.methods == ("FILL_MEAN", "FILL_MODE", "KEEP_FIRST", "CAP_OUTLIERS")
    assert found.limits.null_high == 15.0 and found.limits.outlier_high == 5.0
    nothing = L.learned_inputs(_patterns(spark, ("X", "y_z", 0.9, 0.4)))
    assert nothing.confidence == 0.5 and nothing.methods[0] == "FILL_MEDIAN"
