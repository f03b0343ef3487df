import random

import pytest
from pyspark.sql import functions as F

from dqengine.operators import duplicates as D


def _rows():
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, "a", "b"]), rng.choice([None, 0.5])) for _ in range(200)]
    return rows + [(1, "hot", 0.5)] * 100 + [(None, "x", None), (9, None, None)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(_rows(), "a int, b string, c double").repartition(5)


@pytest.mark.parametrize("fingerprint_rows", [10**9, 0])
def test_counts_and_removal(frame, fingerprint_rows):
    rows = _rows()
    distinct = set(rows)
    assert D.duplicate_count(frame, fingerprint_rows).first()[0] == len(rows) - len(distinct)
    kept = [tuple(r) for r in D.drop_duplicate_rows(frame, fingerprint_rows).collect()]
    assert len(kept) == len(distinct) and set(kept) == distinct
    copies = {tuple(r)[:3]: r["copies"] for r in D.row_copies(frame, fingerprint_rows).collect()}
    assert copies == {r: rows.count(r) for r in distinct}


def test_colliding_fingerprints_are_told_apart(frame, monkeypatch):
    monkeypatch.setattr(D, "row_fingerprint", lambda df: F.lit(1).cast("long"))
    rows = _rows()
    assert D.duplicate_count(frame, 0).first()[0] == len(rows) - len(set(rows))
    assert D.drop_duplicate_rows(frame, 0).count() == len(set(rows))


@pytest.mark.parametrize("maps", [1, 7])
def test_more_repeats_than_a_filter_has_room_for(spark, monkeypatch, maps):
    monkeypatch.setattr(D, "FILTER_MAPS", maps)
    rows = spark.range(60_000).selectExpr("id % 50000 as a", "cast(id % 50000 as string) as b")
    assert D.drop_duplicate_rows(rows, 0).count() == 50_000
    assert D.duplicate_count(rows, 0).first()[0] == 10_000
    copies = {r["copies"]: r["n"] for r in D.row_copies(rows, 0).groupBy("copies").agg(F.count("*").alias("n")).collect()}
    assert copies == {1: 40_000, 2: 10_000}


def test_unique_rows_outside_the_filter_stay_in_place(spark):
    rows = spark.range(40_000).selectExpr("id as a").union(spark.range(10).selectExpr("id as a"))
    unique, candidates = D._split(rows, 0)
    assert candidates.count() < 200 and unique.count() + candidates.count() == 40_010
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_null_positions_differ(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    prints = [r[0] for r in df.select(D.row_fingerprint(df)).collect()]
    assert prints[0] != prints[1]
    assert D.duplicate_count(df).first()[0] == 0


def test_maps_are_compared_as_text(spark):
    df = spark.createDataFrame([({"k": 1},), ({"k": 1},), ({"k": 2},)], "m map<string,int>")
    assert D.duplicate_count(df).first()[0] == 1
    kept = D.drop_duplicate_rows(df)
    assert kept.count() == 2 and kept.dtypes == [("m", "map<string,int>")]


def test_one_row_per_key(spark):
    rows = [("u", 1, "old"), ("u", 3, "new"), ("u", None, "none"), ("v", 2, "only")]
    df = spark.createDataFrame(rows, "k string, t int, s string")
    last = {tuple(r) for r in D.keep_one_per_key(df, ["k"], ["t"], "last").collect()}
    assert last == {("u", 3, "new"), ("v", 2, "only")}
    with pytest.raises(ValueError):
        D.keep_one_per_key(df, ["k"], ["t"], "middle")
