import random

import pandas as pd
import pytest

from dqengine import session
from dqengine.operators.fill import fill_along


def _table(spark, keyed=True):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(6)}"
        rows.append((key, None if i == 7 else i, None if rng.random() < 0.6 else float(rng.randrange(1000)), i))
    return rows, spark.createDataFrame(rows, "k string, t int, v double, id int").repartition(6)


def _expected(rows, keyed, forward):
    df = pd.DataFrame(rows, columns=["k", "t", "v", "id"])
    df = df.sort_values("t", na_position="first")
    grouped = df.groupby("k")["v"] if keyed else df["v"]
    df["v"] = grouped.ffill() if forward else grouped.bfill()
    return {r.id: (None if pd.isna(r.v) else r.v) for r in df.itertuples()}


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("rows_per_chunk", [10**6, 25])
def test_fill_equals_pandas(spark, keyed, forward, rows_per_chunk):
    rows, df = _table(spark)
    filled = fill_along(df, "v", ["t"], ["k"] if keyed else [], forward, rows_per_chunk)
    assert filled.columns == df.columns
    assert {r["id"]: r["v"] for r in filled.collect()} == _expected(rows, keyed, forward)


def test_timestamps_and_null_keys(spark):
    df = spark.sql(
        "select cast(null as string) k, timestamp'2024-01-01' + make_dt_interval(0, 0, cast(id as int)) t, "
        "if(id % 10 = 0, id, null) v, id from range(100)"
    )
    got = {r["id"]: r["v"] for r in fill_along(df, "v", ["t"], ["k"], True, 9).collect()}
    assert got == {i: i - i % 10 for i in range(100)}


def test_one_order_value_only(spark):
    df = spark.createDataFrame([("a", 1, 5.0, 0)] * 30, "k string, t int, v double, id int")
    assert fill_along(df, "v", ["t"], ["k"], True, 4).count() == 30


@pytest.mark.parametrize("forward", [True, False])
def test_small_chunks_do_not_add_ranges(spark, forward):
    df = spark.range(4000, numPartitions=4).selectExpr("id", "if(id % 50 = 7, id, null) v")
    filled = fill_along(df, "v", ["id"], forward=forward, rows_per_chunk=10)
    chunked = spark.read.parquet(session._scratch[-1])
    # The driver gets a result and a sample from each range: one for every chunk before, 400 of them.
    assert len(chunked.inputFiles()) <= 32
    chunks = chunked.groupBy("__chunk").agg({"*": "count", "id": "min"}).toDF("chunk", "rows", "first").orderBy("chunk").collect()
    assert len(chunks) >= 400 and max(r["rows"] for r in chunks) <= 10
    assert [r["first"] for r in chunks] == sorted(r["first"] for r in chunks)
    got = {r["id"]: r["v"] for r in filled.collect()}
    step = (lambda i: (i - 7) // 50 * 50 + 7) if forward else (lambda i: -(-(i - 7) // 50) * 50 + 7)
    assert got == {i: v if 0 <= (v := step(i)) < 4000 else None for i in range(4000)}
