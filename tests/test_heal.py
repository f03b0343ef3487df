import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.operators import heal as H
from dqengine.operators.heal import Action, heal, heal_by_group, repair


def _values(df, column):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda v: (v is None, v))


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, 10, "a"), (2, None, None), (3, 30, "b"), (4, 50, "b"), (5, None, "a"), (5, None, "a")]
    return spark.createDataFrame(rows, "id int, age int, team string")


def test_fills(people):
    assert _values(repair(people, "FILL_MEAN", "age"), "age") == [10.0, 30.0, 30.0, 30.0, 30.0, 50.0]
    assert _values(repair(people, "FILL_MEDIAN", "age"), "age").count(30.0) == 4
    assert _values(repair(people, "FILL_MODE", "team"), "team").count("a") == 4
    assert "Unknown" in _values(repair(people, "FILL_DEFAULT", "team"), "team")
    assert dict(repair(people, "FILL_MEAN", "age").dtypes)["age"] == "double"


def test_fill_default_needs_text_or_a_cast(people):
    with pytest.raises(ValueError):
        repair(people, "FILL_DEFAULT", "age")
    filled = repair(people, "FILL_DEFAULT", "age", cast_to_text=True)
    assert _values(filled, "age").count("Unknown") == 3


def test_row_methods(people):
    assert repair(people, "DELETE_ROWS", "age").count() == 3
    assert repair(people, "KEEP_FIRST").count() == 5
    assert repair(people, "DROP_COLUMNS", "age").columns == ["id", "team"]


def test_cap_is_upper_only_and_keeps_nulls(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)] + [(None,), (-1000.0,)], "x double")
    capped = _values(repair(df, "CAP_OUTLIERS", "x"), "x")
    assert capped[0] == -1000.0 and capped[-1] is None
    limit = max(v for v in capped if v is not None)
    # position .95 * 101 = 95.95 in -1000, 0, 1, ..., 100
    assert limit == pytest.approx(94.95) and capped.count(limit) == 6


def test_z_filter_drops_nulls_and_constant_columns(spark):
    rows = [(float(i % 7),) for i in range(100)] + [(1000.0,), (None,)]
    df = spark.createDataFrame(rows, "x double")
    assert repair(df, "REMOVE_OUTLIERS", "x").count() == 100
    constant = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert repair(constant, "REMOVE_OUTLIERS", "x").count() == 0


def test_log_transform_edges(spark):
    df = spark.createDataFrame([(0.0,), (math.e - 1,), (-1.0,), (-5.0,), (None,)], "x double")
    values = _values(repair(df, "LOG_TRANSFORM", "x"), "x")
    assert values[0] == 0.0 and values[1] == pytest.approx(1.0) and values[2:] == [None] * 3


def test_failures_are_logged_and_skipped(spark, people):
    blank = people.withColumn("empty", F.lit(None).cast("string"))
    steps = [
        Action("HANDLE_NULLS", "FILL_MEAN", "team"),
        Action("HANDLE_NULLS", "FILL_MODE", "empty"),
        Action("HANDLE_NULLS", "FILL_MEAN", "missing"),
        Action("HANDLE_NULLS", "NO_SUCH", "age"),
        Action("HANDLE_NULLS", "FILL_FORWARD", "age"),
        Action("HANDLE_NULLS", "FILL_MEDIAN", "age"),
    ]
    healed = heal(blank, steps)
    log = healed.log.orderBy("step").collect()
    assert [r["success"] for r in log] == [False] * 5 + [True]
    assert log[-1]["cells_changed"] == 3 and "Execution failed" in log[0]["message"]
    assert healed.df.count() == 6


def test_later_steps_see_earlier_results(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (100.0, None), (100.0, None)], "x double, t string")
    steps = [
        Action("HANDLE_NULLS", "DELETE_ROWS", "t"),
        Action("HANDLE_NULLS", "FILL_MEAN", "x"),
    ]
    healed = heal(df, steps)
    assert _values(healed.df, "x") == [1.0, 1.0]
    assert [e["records_affected"] for e in healed.entries] == [2, 0]


def test_log_counts(spark):
    df = spark.createDataFrame([(float(i), "a") for i in range(40)] * 2 + [(None, "a")], "x double, t string")
    steps = [
        Action("HANDLE_NULLS", "FILL_MEDIAN", "x"),
        Action("REMOVE_DUPLICATES", "KEEP_FIRST"),
        Action("HANDLE_OUTLIERS", "CAP_OUTLIERS", "x"),
        Action("HANDLE_OUTLIERS", "CUSTOM_TRANSFORMATION", options={"transform": lambda d: d.where("x > 5")}),
    ]
    entries = heal(df, steps).entries
    assert [(e["rows_before"], e["rows_after"]) for e in entries] == [(81, 81), (81, 41), (41, 41), (41, 35)]
    assert [e["cells_changed"] for e in entries] == [1, 0, 2, 0]
    written = heal(df, steps, write_end=True)
    assert [e["rows_after"] for e in written.entries] == [81, 41, 41, 35] and written.df.count() == 35


def test_fills_and_dedupe_are_idempotent(people):
    steps = [
        Action("HANDLE_NULLS", "FILL_MEDIAN", "age"),
        Action("HANDLE_NULLS", "FILL_MODE", "team"),
        Action("REMOVE_DUPLICATES", "KEEP_FIRST"),
    ]
    once = heal(people, steps, measure=False).df
    twice = heal(once, steps, measure=False).df
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_stages_split_where_numbers_change():
    steps = [
        Action("N", "FILL_MEAN", "a"),
        Action("N", "FILL_MEDIAN", "b"),
        Action("N", "CAP_OUTLIERS", "a"),
        Action("N", "DELETE_ROWS", "c"),
        Action("N", "FILL_MEAN", "d"),
    ]
    assert [[a.column for a in stage] for stage in H._stages(steps)] == [["a", "b"], ["a", "c"], ["d"]]


@pytest.mark.parametrize("direct_rows", [10**6, 10])
def test_group_statistics_are_local(spark, direct_rows):
    rows = [("a", float(i)) for i in range(21)] + [("b", 1000.0), ("b", None), (None, 5.0), (None, None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    healed = heal_by_group(df, [Action("HANDLE_NULLS", "FILL_MEDIAN", "x")], ["g"], direct_rows=direct_rows)
    got = sorted(((r["g"] or ""), r["x"]) for r in healed.collect())
    assert ("b", 1000.0) in got and got.count(("b", 1000.0)) == 2
    assert got.count(("", 5.0)) == 2 and got.count(("a", 10.0)) == 2
    assert healed.columns == ["g", "x"]


def test_group_mode_and_z_filter(spark):
    rows = [("a", "x", float(i % 5)) for i in range(60)] + [("a", None, 900.0), ("b", "y", 1.0), ("b", None, 2.0)]
    df = spark.createDataFrame(rows, "g string, t string, v double")
    steps = [Action("HANDLE_NULLS", "FILL_MODE", "t"), Action("HANDLE_OUTLIERS", "REMOVE_OUTLIERS", "v")]
    healed = heal_by_group(df, steps, ["g"])
    assert healed.where("g = 'a'").count() == 60 and healed.where("g = 'b' and t = 'y'").count() == 2
    with pytest.raises(ValueError):
        heal_by_group(df, [Action("HANDLE_NULLS", "FILL_MEAN", "t")], ["g"])


def test_before_after(people):
    fixed = repair(repair(people, "FILL_MEDIAN", "age"), "KEEP_FIRST")
    rows = {r["phase"]: tuple(r)[1:] for r in H.compare_before_after(people, fixed).collect()}
    assert rows == {"before": (6, 4, 1), "after": (5, 1, 0)}


def test_modes_keep_their_type(spark):
    rows = [(1, [1, 2], bytearray(b"\xff\xfe"), ("x", 1)), (2, [1, 2], bytearray(b"\xff\xfe"), ("x", 1)), (3, None, None, None)]
    df = spark.createDataFrame(rows, "k int, a array<int>, b binary, s struct<t: string, n: int>")
    healed = heal(df, [Action("HANDLE_NULLS", "FILL_MODE", c) for c in ("a", "b", "s")])
    got = healed.df.where("k = 3").first()
    assert (got.a, bytes(got.b), tuple(got.s)) == ([1, 2], b"\xff\xfe", ("x", 1))
    assert healed.df.schema.simpleString() == df.schema.simpleString()


def test_a_failing_action_is_logged_and_the_fold_goes_on(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, None)], "x double, t string")
    broken = Action("HANDLE_NULLS", "CUSTOM_TRANSFORMATION", None, options={"transform": lambda d: d.select("missing")})
    healed = heal(df, [broken, Action("HANDLE_NULLS", "FILL_MEAN", "x")])
    assert healed.df.where("x is null").count() == 0
    assert len(healed.entries) == 2


def test_large_numbers_come_through_unchanged(spark):
    from decimal import Decimal

    big, fine = 9007199254740993, Decimal("1234567890123456789012345678.91")
    rows = [(big, fine, 1), (big + 2, fine, 2), (None, None, None), (5, Decimal("1.00"), 3)]
    df = spark.createDataFrame(rows, "n bigint, d decimal(30,2), small bigint")
    for method in ("FILL_MEAN", "FILL_MEDIAN", "CAP_OUTLIERS", "OUTLIER_IQR"):
        for column, cell in (("n", big), ("d", fine)):
            healed = repair(df, method, column)
            assert isinstance(healed.schema[column].dataType, T.DecimalType)
            kept = [v for v in _values(healed, column) if v is not None]
            assert cell in kept, (method, column)
        assert dict(repair(df, method, "small").dtypes)["small"] == "double"
    assert Decimal(6004799503160663) + Decimal(2) / 3 - repair(df, "FILL_MEAN", "n").where("small is null").first()["n"] < Decimal("0.00001")
    by_group = heal_by_group(df.withColumn("g", F.lit("a")), [Action("HANDLE_NULLS", "FILL_MEDIAN", "n")], ["g"])
    assert big in _values(by_group, "n") and big + 2 in _values(by_group, "n")


def test_custom_steps_are_rolled_back(spark):
    def refuse(d):
        raise ValueError("no such thing")

    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (None, "b")], "x double, t string")
    steps = [
        Action("HANDLE_NULLS", "DELETE_ROWS", "t"),
        Action("CUSTOM", "CUSTOM_TRANSFORMATION", options={"transform": refuse}),
        Action("HANDLE_NULLS", "FILL_MEAN", "x"),
        Action("CUSTOM", "CUSTOM_TRANSFORMATION", options={"transform": lambda d: d.withColumn("t", F.col("t").cast("int"))}),
        Action("CUSTOM", "CUSTOM_TRANSFORMATION", options={"transform": lambda d: 5}),
        Action("CUSTOM", "CUSTOM_TRANSFORMATION", options={"transform": lambda d: d.withColumn("u", F.lit(1))}),
        Action("REMOVE_DUPLICATES", "KEEP_FIRST"),
    ]
    for measure in (True, False):
        healed = heal(df, steps, measure=measure)
        assert [e["success"] for e in healed.entries] == [True, False, True, False, False, True, True]
        assert "no such thing" in healed.entries[1]["message"]
        assert sorted(map(tuple, healed.df.collect())) == [(1.0, "a", 1), (1.0, "b", 1)]
