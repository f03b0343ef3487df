import pytest
from pyspark.sql import functions as F

from dqengine.operators.facts import table_facts
from dqengine.operators.profile import find_issues
from dqengine.plans import repair_plan as R
from dqengine.plans import workflows as W
from dqengine.schemas import ISSUE_SCHEMA

STATS = "column_name string, mean_value double, std_value double, median_value double"


def _plan(spark, issues, numeric=("n",), **kw):
    rows = [(t, c, a, 100, float(a), s, "full_scan") for t, c, a, s in issues]
    stats = spark.createDataFrame([(c, 10.0, 2.0, 10.1) for c in numeric], STATS)
    plan = R.propose_actions(spark.createDataFrame(rows, ISSUE_SCHEMA), stats, numeric=numeric, **kw)
    return {r["action_id"]: r for r in plan.collect()}


def test_which_issues_become_actions(spark):
    plan = _plan(
        spark,
        [
            ("NULL_VALUES", "n", 4, "LOW"),
            ("NULL_VALUES", "t", 40, "HIGH"),
            ("DUPLICATES", None, 3, "MEDIUM"),
            ("OUTLIERS", "n", 1, "LOW"),
            ("OUTLIERS", "m", 3, "MEDIUM"),
            ("DUPLICATES_ESTIMATED", None, 9, "HIGH"),
            ("OUTLIERS_ESTIMATED", "n", 9, "HIGH"),
        ],
    )
    assert set(plan) == {
        "HANDLE_NULLS:n", "HANDLE_NULLS:t", "REMOVE_DUPLICATES:*", "HANDLE_OUTLIERS:m",
    }
    assert plan["HANDLE_NULLS:n"]["recommended_method"] == "FILL_MEDIAN"
    assert plan["HANDLE_NULLS:t"]["recommended_method"] == "FILL_MODE"
    assert plan["REMOVE_DUPLICATES:*"]["recommended_method"] == "KEEP_FIRST"
    assert plan["HANDLE_OUTLIERS:m"]["recommended_method"] == "CAP_OUTLIERS"


def test_confidence_by_hand(spark):
    plan = _plan(spark, [("NULL_VALUES", "n", 4, "LOW"), ("NULL_VALUES", "t", 20, "HIGH"), ("DUPLICATES", None, 3, "LOW")])
    assert plan["HANDLE_NULLS:n"]["confidence"] == 0.8  # (.95 + .85 + .50 + .90) / 4
    # (.60 + .70 + .50 + .50) / 4 is just below .575 in binary
    assert plan["HANDLE_NULLS:t"]["confidence"] == 0.57
    assert plan["REMOVE_DUPLICATES:*"]["confidence"] == 0.78  # (.95 + .50 + .90) / 3
    assert {r["disposition"] for r in plan.values()} == {"PENDING"}


def test_learning_opens_automatic_execution(spark):
    issues = [("NULL_VALUES", "n", 4, "LOW"), ("DUPLICATES", None, 3, "LOW")]
    below = _plan(spark, issues, learning_confidence=0.80)
    assert {r["disposition"] for r in below.values()} == {"PENDING"}
    above = _plan(spark, issues, learning_confidence=0.90)
    assert {r["disposition"] for r in above.values()} == {"AUTO"}
    assert {r["risk_level"] for r in above.values()} == {"LOW"}
    boosted = _plan(spark, issues, learning_confidence=0.75, preferred_methods=("KEEP_FIRST",))
    assert boosted["REMOVE_DUPLICATES:*"]["disposition"] == "AUTO"
    assert boosted["HANDLE_NULLS:n"]["disposition"] == "PENDING"
    capped = _plan(spark, issues, learning_confidence=0.95, preferred_methods=("KEEP_FIRST",))
    assert capped["REMOVE_DUPLICATES:*"]["confidence"] == 0.95  # boost is cut at 1


def test_approval_rule(spark):
    plan = _plan(
        spark,
        [("NULL_VALUES", "a", 10, "LOW"), ("NULL_VALUES", "b", 11, "LOW"), ("NULL_VALUES", "c", 6, "MEDIUM")],
    )
    assert plan["HANDLE_NULLS:a"]["approval_status"] == "AUTO_APPROVED"
    assert plan["HANDLE_NULLS:b"]["approval_status"] == "NEEDS_APPROVAL"
    assert plan["HANDLE_NULLS:c"]["approval_status"] == "NEEDS_APPROVAL"
    assert plan["HANDLE_NULLS:c"]["impact"] == "Affects 6 records (6.0%)"


def test_risk_levels(spark):
    cases = [(0.90, "LOW", "LOW"), (0.89, "LOW", "MEDIUM"), (0.95, "MEDIUM", "MEDIUM"), (0.74, "LOW", "HIGH"), (0.99, "HIGH", "HIGH")]
    df = spark.createDataFrame(cases, "c double, s string, expected string")
    rows = df.select(R.risk_level(F.col("c"), F.col("s")).alias("got"), "expected").collect()
    assert all(r["got"] == r["expected"] for r in rows)


def test_reasoning_and_options(spark):
    plan = _plan(spark, [("NULL_VALUES", "n", 40, "HIGH"), ("DUPLICATES", None, 30, "HIGH")])
    nulls, copies = plan["HANDLE_NULLS:n"], plan["REMOVE_DUPLICATES:*"]
    assert nulls["options"][0]["description"] == "Fill with mean value (10.00)"
    assert "Mean and median agree, so the values look symmetric" in nulls["thoughts"]
    assert nulls["risks"] == ["40.0% of the column would be invented values"]
    assert copies["risks"] == ["Rows that are rightly equal would go as well"]


@pytest.fixture(scope="module")
def dirty(spark):
    rows = spark.range(200).select(
        "id",
        F.when(F.col("id") % 20 != 0, (F.col("id") % 7).cast("double")).alias("v"),
        F.when(F.col("id") % 8 != 0, F.lit("x")).alias("t"),
    )
    return rows.unionAll(rows.where("id < 10"))


def test_feed_repair_passes_validation(dirty):
    done = W.repair_feed(dirty, "feed")
    report = done.validation.first()
    assert report["validation_status"] == "PASSED"
    assert report["final_quality_score"] >= report["original_quality_score"]
    assert report["healing_actions_executed"] == len(done.healed.entries) == 3
    assert find_issues(done.healed.df).where("issue_type <> 'OUTLIERS'").count() == 0


def test_processing_waits_for_approval(dirty):
    done = W.process_dataset(dirty, "upload")
    assert done.status == "PENDING_APPROVAL" and done.healed.entries == []
    kinds = {r["action_type"] for r in done.action_log.collect()}
    assert "DATASET_PROCESSING_START" in kinds and "HEALING_PROPOSED_HANDLE_NULLS" in kinds
    row = done.summary.first()
    assert row["final_quality_score"] == row["quality_score"]


def test_clean_table_completes(spark):
    done = W.process_dataset(spark.range(50).withColumn("v", F.col("id") * 1.0), "clean")
    assert done.status == "COMPLETED" and done.actions.count() == 0
    kinds = [r["action_type"] for r in done.action_log.collect()]
    assert "NO_ISSUES_FOUND" in kinds and "HEALING_PLAN_COMPLETE" not in kinds


def test_auto_approved_can_be_executed(spark):
    df = spark.range(100).select("id", F.when(F.col("id") > 3, F.lit("x")).alias("t"))
    assert W.process_dataset(df, "d").healed.entries == []
    done = W.process_dataset(df, "d", execute_auto_approved=True)
    assert [e["method"] for e in done.healed.entries] == ["FILL_MODE"]
    assert done.summary.first()["final_quality_score"] == 100.0
    log = {r["action_type"]: r["action_details"] for r in done.action_log.collect()}
    assert log["AUTO_EXECUTION_COMPLETE"] == "Auto-executed 1 actions. Quality score: 96.0% to 100.0% (+4.0%)"


def test_decisions_are_matched_by_id(spark, dirty):
    plan = R.plan_for(dirty, find_issues(dirty))
    decisions = spark.createDataFrame(
        [("HANDLE_NULLS:t", True, "FILL_DEFAULT"), ("REMOVE_DUPLICATES:*", False, None)],
        "action_id string, approved boolean, method string",
    )
    healed = W.run_decisions(dirty, plan, decisions)
    assert [(e["action_id"], e["method"]) for e in healed.entries] == [("HANDLE_NULLS:t", "FILL_DEFAULT")]
    log = W.decision_log(plan, healed.log).collect()
    assert sorted(r["action_type"] for r in log) == ["APPROVED_HANDLE_NULLS", "EXECUTED_HANDLE_NULLS"]


def test_failed_execution_gives_one_log_row(spark, dirty):
    plan = R.plan_for(dirty, find_issues(dirty))
    decisions = spark.createDataFrame(
        [("HANDLE_NULLS:t", True, "FILL_MEAN")], "action_id string, approved boolean, method string"
    )
    log = W.decision_log(plan, W.run_decisions(dirty, plan, decisions).log).collect()
    assert [(r["action_type"], r["execution_status"]) for r in log] == [("FAILED_HANDLE_NULLS", "FAILED")]


def test_summary_lists_types_once(spark, dirty):
    row = R.plan_summary(R.plan_for(dirty, find_issues(dirty))).first()
    assert tuple(row) == (3, "HANDLE_NULLS, REMOVE_DUPLICATES")


def test_a_whole_repair_scans_the_table_few_times(spark):
    """Profile, plan and first repairs share their scans; the table is read once more for every step that needs it."""
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    plain = spark.range(2000).selectExpr(
        "if(id % 10 = 0, null, cast(id % 97 as double)) as a", "if(id % 200 = 0, 9e9, cast(id % 13 as double)) as b",
        "if(id % 7 = 0, null, cast(id % 3 as string)) as t",
    )
    df = plain.mapInArrow(counted, plain.schema)
    facts = table_facts(df)
    assert rows.value <= 5 * 2000
    expected = {tuple(r) for r in find_issues(plain).collect()}
    assert {tuple(r) for r in facts.issues(df).collect()} == expected
    statistics = {tuple(r) for r in R.column_statistics(plain, ["a"]).collect()}
    known = {tuple(r) for r in facts.statistics(df, ["a"]).select("column_name", "mean_value", "std_value", "median_value").collect()}
    assert sorted((r[0], *[round(v, 9) for v in r[1:]]) for r in known) == sorted(
        (r[0], *[round(v, 9) for v in r[1:]]) for r in statistics
    )
    rows.value = 0
    done = W.repair_feed(df, "few", measure=False)
    assert rows.value <= 7 * 2000  # facts, modes, and the repair itself
    assert {e["success"] for e in done.healed.entries} == {True} and done.healed.df.where("a is null or t is null").count() == 0
