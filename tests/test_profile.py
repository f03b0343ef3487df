import pytest
from pyspark.sql import functions as F

from dqengine.operators import profile as P
from dqengine.schemas import DEFAULT_THRESHOLDS, SAMPLED_THRESHOLDS


def _issues(df, **kw):
    return {(r["issue_type"], r["column_name"]): r for r in P.find_issues(df, **kw).collect()}


def test_clean_table_has_no_issues_and_full_score(spark):
    df = spark.range(10).withColumn("t", F.col("id").cast("string"))
    assert _issues(df) == {}
    assert P.quality_score(P.find_issues(df)).first()[0] == 100.0


def test_nan_counts_as_missing_and_is_no_outlier(spark):
    rows = [(float(i % 5),) for i in range(50)] + [(float("nan"),), (None,)]
    found = _issues(spark.createDataFrame(rows, "x double"))
    assert found[("NULL_VALUES", "x")]["affected_rows"] == 2
    assert ("OUTLIERS", "x") not in found


def test_constant_and_single_row_columns_have_no_outliers(spark):
    constant = spark.createDataFrame([(1.0, i) for i in range(20)], "x double, i int")
    assert ("OUTLIERS", "x") not in _issues(constant)
    assert _issues(spark.createDataFrame([(1.0,)], "x double")) == {}


def test_all_null_and_boolean_and_time_columns(spark):
    df = spark.sql("select cast(null as double) x, id > 3 b, timestamp'2024-01-01' t, id from range(5)")
    found = _issues(df)
    assert found[("NULL_VALUES", "x")]["percentage"] == 100.0
    assert P.numeric_columns(df) == ["x", "id"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, t string")
    assert _issues(df) == {}
    assert P.recalculated_score(df).first()["quality_score"] == 100.0


@pytest.mark.parametrize(
    "nulls,grade", [(5, "LOW"), (6, "MEDIUM"), (10, "MEDIUM"), (11, "HIGH")]
)
def test_null_limits_are_exclusive(spark, nulls, grade):
    df = spark.range(100).select(F.when(F.col("id") >= nulls, F.col("id").cast("string")).alias("t"), "id")
    assert _issues(df)[("NULL_VALUES", "t")]["severity"] == grade


@pytest.mark.parametrize("extra,grade", [(2, "LOW"), (3, "MEDIUM"), (6, "HIGH")])
def test_duplicate_limits(spark, extra, grade):
    df = spark.range(100 - extra).unionAll(spark.range(extra))
    row = _issues(df)[("DUPLICATES", None)]
    assert (row["affected_rows"], row["severity"]) == (extra, grade)


def test_profiles_differ(spark):
    df = spark.range(100).select(F.when(F.col("id") >= 12, F.col("id")).alias("v"), "id")
    assert _issues(df, limits=DEFAULT_THRESHOLDS)[("NULL_VALUES", "v")]["severity"] == "HIGH"
    assert _issues(df, limits=SAMPLED_THRESHOLDS)[("NULL_VALUES", "v")]["severity"] == "MEDIUM"


def test_score_never_negative_and_may_count_a_row_often(spark):
    df = spark.sql("select cast(null as string) a, cast(null as string) b from range(4)")
    score = P.recalculated_score(df).first()
    assert score["missing_cells"] == 8 and score["duplicates"] == 3
    assert score["quality_score"] == 0.0


def test_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(None, 1.0), (1, 1.0), (2, None)], "`a.b` int, `c d` double")
    found = _issues(df)
    assert found[("NULL_VALUES", "a.b")]["affected_rows"] == 1
    assert found[("NULL_VALUES", "c d")]["affected_rows"] == 1


def test_fingerprint_path_finds_the_same(spark):
    df = spark.range(60).unionAll(spark.range(7)).withColumn("v", F.col("id") * 2.0)
    plain = sorted(map(tuple, P.find_issues(df).collect()))
    assert plain == sorted(map(tuple, P.find_issues(df, fingerprint_rows=0).collect()))


def test_iqr_fences_are_exclusive_on_both_paths(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 17, 18]], "x double")
    for direct in (100, 1):
        row = P.iqr_outlier_counts(df, direct_rows=direct).first()
        assert row["affected_rows"] == 2  # fences at 3.5 - 7.5 and 8.5 + 7.5


def test_problem_rows_weights(spark):
    rows = [(1.0, "a")] * 3 + [(2.0, "b"), (None, "c"), (None, "c")]
    df = spark.createDataFrame(rows, "x double, t string")
    few = {r["t"]: (r["reasons"], r["problem_rows"]) for r in P.problem_rows(df, min_values=1000).collect()}
    assert few == {"a": (["DUPLICATE"], 2), "c": (["NULL", "DUPLICATE"], 2)}
    # By default small columns are checked for outliers too.
    found = {r["t"]: (r["reasons"], r["problem_rows"]) for r in P.problem_rows(df).collect()}
    assert found == few | {"b": (["OUTLIER:x"], 1)}
    again = {r["t"]: (r["reasons"], r["problem_rows"]) for r in P.problem_rows(df, fingerprint_rows=0).collect()}
    assert again == found


def test_size_never_decides_the_mode(spark):
    methods = lambda df: {r["analysis_method"] for r in df.collect()}
    for rows in (1_000, 100_001):
        table = spark.range(rows).select((F.col("id") % 900).alias("k"), F.lit(None).cast("string").alias("n"))
        assert methods(P.profile(table)) == {"full_scan"}
        assert "selective_rows" in methods(P.profile(table, "sampled"))
    with pytest.raises(ValueError):
        P.profile(spark.range(3), mode="guess")


def test_hash_sample_share_and_stability(spark):
    df = spark.range(20_000)
    first = {r[0] for r in P.hash_sample(df, "id", 0.25).collect()}
    again = {r[0] for r in P.hash_sample(df.repartition(13), "id", 0.25).collect()}
    assert first == again and 0.23 < len(first) / 20_000 < 0.27
    assert P.hash_sample(df, "id", 1.0).count() == 20_000


@pytest.mark.parametrize("score,tier", [(90.0, "Excellent"), (89.99, "Good"), (70.0, "Good"), (69.99, "Needs Healing")])
def test_tiers(spark, score, tier):
    assert spark.range(1).select(P.score_tier(F.lit(score))).first()[0] == tier


@pytest.mark.parametrize("score,colour,step", [(80.0, "green", 3), (79.9, "amber", 2), (60.0, "amber", 2), (50.0, "red", 2), (49.9, "red", 1)])
def test_bands(spark, score, colour, step):
    row = spark.range(1).select(P.score_colour(F.lit(score)), P.gauge_step(F.lit(score))).first()
    assert tuple(row) == (colour, step)


def test_top_issues_and_report(spark):
    df = spark.createDataFrame([(None, None, 1), (None, "x", 2), (1, "y", 3)], "a int, b string, c int")
    issues = P.find_issues(df)
    assert [r["column_name"] for r in P.top_issues(issues, 1).collect()] == ["a"]
    report = P.quality_report(df, "t", issues).first()
    assert report["issue_count"] == 2 and report["needs_attention"]
    texts = {r["recommendation"] for r in P.recommendations(issues).collect()}
    assert "Critical: Fill or remove 2 null values in a (66.67%)" in texts
