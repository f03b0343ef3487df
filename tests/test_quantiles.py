import numpy as np
import pytest

from dqengine.functions import quantiles as Q
from dqengine.functions.quantiles import exact_quantiles, most_frequent_values, quantile_values

SHARES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def _columns():
    rng = np.random.default_rng(7)
    n = 3000
    hot = np.where(np.arange(n) % 3 == 0, 5.0, rng.normal(0, 100, n))
    return {
        "spread": rng.lognormal(3, 2, n),
        "hot": hot,
        "nearly_constant": np.where(np.arange(n) < 3, [-1.0] * n, 7.0),
        "negative": -rng.exponential(10, n),
        "whole": rng.integers(-5, 5, n).astype(float),
    }


@pytest.fixture(scope="module")
def frame(spark):
    data = _columns()
    rows = [tuple(float(v) for v in r) for r in zip(*data.values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(7)


def test_narrowing_equals_numpy(frame, monkeypatch):
    monkeypatch.setattr(Q, "_bracketed", lambda *a: None)
    found = quantile_values(frame, frame.columns, SHARES, direct_rows=20)
    for name, values in _columns().items():
        for p in SHARES:
            assert found[name][p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("sample_rows", [10**6, 900])
def test_brackets_equal_numpy(frame, monkeypatch, sample_rows):
    monkeypatch.setattr(Q, "SMALL_ROWS", 10)
    monkeypatch.setattr(Q, "SAMPLE_ROWS", sample_rows)
    monkeypatch.setattr(Q, "_narrowed", None)
    found = quantile_values(frame, frame.columns, SHARES)
    for name, values in _columns().items():
        for p in SHARES:
            assert found[name][p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("shift", [-1000.0, 1000.0])
def test_a_missed_bracket_is_narrowed(frame, monkeypatch, shift):
    monkeypatch.setattr(Q, "SMALL_ROWS", 10)
    monkeypatch.setattr(Q, "_brackets", lambda *a: [Q._Target("hot", 0.5, shift, shift + 1)])
    assert quantile_values(frame, ["hot"], [0.5])["hot"][0.5] == np.quantile(_columns()["hot"], 0.5)


def test_a_full_bracket_is_narrowed(frame, monkeypatch):
    monkeypatch.setattr(Q, "SMALL_ROWS", 10)
    monkeypatch.setattr(Q, "_brackets", lambda *a: [Q._Target("spread", 0.5, None, None)])
    found = quantile_values(frame, ["spread"], [0.5], direct_rows=100)
    assert found["spread"][0.5] == pytest.approx(np.quantile(_columns()["spread"], 0.5))


def test_coarse_sketch_stays_exact(frame, monkeypatch):
    monkeypatch.setattr(Q, "SMALL_ROWS", 10)
    monkeypatch.setattr(Q, "GRID_ACCURACY", 20)
    found = quantile_values(frame, ["spread", "hot"], [0.05, 0.5, 0.95])
    for name in ("spread", "hot"):
        for p in (0.05, 0.5, 0.95):
            assert found[name][p] == pytest.approx(np.quantile(_columns()[name], p))


def test_direct_equals_numpy(frame):
    found = quantile_values(frame, ["spread"], SHARES)
    for p in SHARES:
        assert found["spread"][p] == pytest.approx(np.quantile(_columns()["spread"], p), rel=1e-12)


def test_nulls_and_empty_columns(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    found = quantile_values(df, ["a", "b"], [0.5])
    assert found["a"][0.5] == 2.0
    assert found["b"][0.5] is None
    bracketed = quantile_values(df, ["a", "b"], [0.5], direct_rows=1)
    assert bracketed == {"a": {0.5: 2.0}, "b": {0.5: None}}
    monkeypatch.setattr(Q, "_bracketed", lambda *a: None)
    narrowed = quantile_values(df, ["a", "b"], [0.5], direct_rows=1)
    assert narrowed["a"][0.5] == 2.0
    assert narrowed["b"][0.5] is None


def test_groups_large_and_small_and_null(spark):
    rng = np.random.default_rng(3)
    rows = [(None, float(v)) for v in rng.normal(0, 1, 900)]
    rows += [("b", float(v)) for v in rng.normal(5, 1, 700)]
    rows += [("c", 1.0), ("c", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {
        (r["g"], r["probability"]): r["value"]
        for r in exact_quantiles(df, ["v"], [0.25, 0.5], by=["g"], direct_rows=100).collect()
    }
    assert len(got) == 6
    for g in (None, "b", "c"):
        values = [v for k, v in rows if k == g]
        for p in (0.25, 0.5):
            assert got[(g, p)] == pytest.approx(np.quantile(values, p))


def test_mode_takes_smallest_on_tie(spark):
    rows = [("b", 2), ("a", 10), ("b", 10), ("a", 2), ("c", None)]
    df = spark.createDataFrame(rows, "t string, n int")
    assert most_frequent_values(df, ["t", "n"]) == {"t": "a", "n": "2"}
    empty = spark.createDataFrame([(None,)], "t string")
    assert most_frequent_values(empty, ["t"]) == {"t": None}
