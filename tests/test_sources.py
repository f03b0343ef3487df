import csv
import io
import json
import random
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from dqengine.sources import catalog, feeds, files, samples, store


def _payloads(spark, *documents):
    rows = [(d if isinstance(d, str) else json.dumps(d),) for d in documents]
    return spark.createDataFrame(rows, "payload string")


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_utf8_and_latin1_csv(spark, tmp_path):
    for name, encoding in (("u.csv", "utf-8"), ("l.csv", "latin-1")):
        (tmp_path / name).write_bytes("name,n\nMüller,1\nÉcole,2\n".encode(encoding))
        got = _rows(files.read_table(spark, str(tmp_path / name)))
        assert got == [{"name": "Müller", "n": 1}, {"name": "École", "n": 2}]


def test_csv_types_and_missing_markers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('i,d,b,t,n\n1,1.5,True,x,NA\n,NaN,False,"a ""q"", b",null\n3,2,True,N/A,\n')
    df = files.read_csv(spark, str(path))
    assert df.dtypes == [("i", "bigint"), ("d", "double"), ("b", "boolean"), ("t", "string"), ("n", "string")]
    assert _rows(df)[1] == {"i": None, "d": None, "b": False, "t": 'a "q", b', "n": None}
    assert df.where("t is null").count() == 1


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('a,b\n1,"x\ny"\n2,z\n')
    assert sorted(r["b"] for r in _rows(files.read_csv(spark, str(path), multi_line=True))) == ["x\ny", "z"]


def _write_all(folder, texts):
    folder.mkdir()
    for name, text in texts.items():
        (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


@pytest.fixture
def tiny_parts(spark):
    """Files are cut into parts of 300 bytes."""
    conf = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_csv_folder_of_three_headers(spark, tmp_path):
    path = _write_all(tmp_path / "h", {"1.csv": "a,b\n1,x\n2,NA\n", "2.csv": "b,a\nz,3\n", "3.csv": "a,b,c\n4,w,5\n"})
    rows = {(1, "x", None), (2, None, None), (3, "z", None), (4, "w", 5)}
    df = files.read_csv(spark, path)
    assert df.columns == ["a", "b", "c"] and {tuple(r) for r in df.collect()} == rows
    assert {tuple(r) for r in files.read_csv(spark, path, schema="a int, b string, d date").collect()} == {
        (a, b, None) for a, b, _ in rows
    }


def test_csv_headers_and_encodings(spark, tmp_path):
    latin = 'näme,n\r\n"Mü\r\nller",1\r\n\r\n5" pipe,2\r\n"a ""q"", b",3\r\n'.encode("latin-1")
    path = _write_all(tmp_path / "e", {"l.csv": latin, "u.csv": "\ufeffn,näme\n4,é\n"})
    got = {tuple(r) for r in files.read_csv(spark, path).select("näme", "n").collect()}
    assert got == {("Mü\r\nller", 1), ('5" pipe', 2), ('a "q", b', 3), ("é", 4)}
    path = _write_all(tmp_path / "n", {"a.csv": '"a\nx",,b,b\n1,2,3,4\n"5","",NA,6\n'})
    df = files.read_csv(spark, path)
    assert df.columns == ["a\nx", "_c1", "b", "b.1"]
    assert {tuple(r) for r in df.collect()} == {(1, 2, 3, 4), (5, None, None, 6)}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_records_across_parts(spark, tmp_path, tiny_parts, end):
    rnd = random.Random(1)
    parts = ("a", "b", '"', ",", "\n", "\r\n", "é", " x", '""')
    rows = [[str(i), *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in "pq")] for i in range(400)]
    rows[200][1] = "long\n" * 300  # a record over several parts
    buffer = io.StringIO()
    writer = csv.writer(buffer, lineterminator=end)
    writer.writerow(["i", "p", "q"])
    writer.writerows(rows)
    path = _write_all(tmp_path / "m", {"a.csv": buffer.getvalue(), "b.csv": "i,p,q\n"})
    df = files.read_csv(spark, path)
    want = {(int(i), *(None if c in files.MISSING_MARKERS else c for c in cells)) for i, *cells in rows}
    assert {tuple(r) for r in df.collect()} == want and df.count() == 400
    assert files._lines(spark, path).rdd.getNumPartitions() > 20


@pytest.mark.parametrize("part_bytes", ["300", "100000"])
def test_csv_lines_stay_in_the_task_that_reads_them(spark, tmp_path, part_bytes):
    rnd = random.Random(2)
    texts, want = {}, set()
    for name in "abcdef":
        rows = [[f"{name}{i}", "\n".join(rnd.choice(("x", 'y"', '"', "", "z,")) for _ in range(rnd.randint(1, 30)))] for i in range(40)]
        buffer = io.StringIO()
        csv.writer(buffer, lineterminator="\n").writerows([["i", "p"], *rows])
        texts[f"{name}.csv"] = buffer.getvalue()
        want |= {(i, None if p in files.MISSING_MARKERS else p) for i, p in rows}
    path = _write_all(tmp_path / "s", texts)
    conf = {
        "spark.sql.files.maxPartitionBytes": part_bytes,  # parts of files, or several files in a task
        "spark.sql.files.openCostInBytes": "1",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "3",  # records are longer
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = files.read_csv(spark, path)
        assert {tuple(r) for r in df.collect()} == want and df.count() == len(want)
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in plan]
    scans = [i for i, line in enumerate(plan) if "FileScan text" in line]
    assert scans
    for i in scans:  # what is above a scan of the files
        at = depth[i]
        for j in range(i, -1, -1):
            if depth[j] < at:
                at = depth[j]
                assert "Exchange" not in plan[j] or "BroadcastExchange" in plan[j], "\n".join(plan)


def test_json_lines_are_judged_one_by_one(spark, tmp_path):
    lines = '{"a": 1}\n{"a": 2}\n{"a":\n{"a": 4} x\n\n{"a": 5},\n{"a": 5}]\n{"a": 5}}\n7\n[{"a": 6}, 8]\n{"a": 9007199254740993}\n{"a": 1.5}\n'
    path = _write_all(tmp_path / "j", {"l.json": lines})
    assert sorted(str(r["a"]) for r in _rows(files.read_json(spark, path))) == ["1.0", "1.5", "2.0", "6.0", "9007199254740993.0"]
    rejected = {(r["text"], r["reason"]) for r in _rows(files.rejected_json(spark, path))}
    assert rejected == {
        ('{"a":', "not JSON"), ('{"a": 4} x', "not JSON"), ('{"a": 5},', "not JSON"), ('{"a": 5}]', "not JSON"), ('{"a": 5}}', "not JSON"),
        ("7", "no object"), ("8", "no object"),
    }


def test_json_documents_are_split_at_their_elements(spark, tmp_path, tiny_parts):
    records = [{"a": i, "s": 'x}"]{\\' * (i % 3), "n": {"k": [{"z": 1}]}} for i in range(60)]
    texts = {
        "pretty.json": json.dumps(records, indent=1),
        "one_line.json": json.dumps(records),
        "lines.json": "\ufeff[\n" + ",\n".join(map(json.dumps, records)) + "\n]\n",
        "single.json": json.dumps(records[7], indent=2),
        "tight.json": "[\n" + ",\n".join(map(json.dumps, records)) + "]",
        "none.json": "[\n]\n",
        "broken.json": '{\n"a": 1\n"s": "no comma"\n}',
    }
    path = _write_all(tmp_path / "d", texts)
    got = sorted((r["a"], r["s"]) for r in _rows(files.read_json(spark, path)))
    assert got == sorted([(r["a"], r["s"]) for r in records] * 4 + [(7, records[7]["s"])])
    assert {r["file"].rsplit("/", 1)[-1] for r in _rows(files.rejected_json(spark, path))} == {"broken.json"}


def test_json_shapes(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "array.json").write_text('[\n{"a": 1},\n{"a": 2}\n]')
    (tmp_path / "columns.json").write_text('{\n"a": [1, 2], "b": ["x", "y"]}')
    assert [r["a"] for r in _rows(files.read_table(spark, str(tmp_path / "lines.json")))] == [1, 2]
    assert [r["a"] for r in _rows(files.read_table(spark, str(tmp_path / "array.json")))] == [1, 2]
    assert _rows(files.read_table(spark, str(tmp_path / "columns.json"))) == [
        {"a": 1, "b": "x"}, {"a": 2, "b": "y"},
    ]


def test_refused_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("a,b\n")
    (tmp_path / "x.xlsx").write_text("")
    with pytest.raises(ValueError, match="empty"):
        files.read_table(spark, str(tmp_path / "empty.csv"))
    with pytest.raises(ValueError, match="Unsupported"):
        files.read_table(spark, str(tmp_path / "x.xlsx"))


def test_series_expansion(spark):
    weather = {
        "latitude": 52.5,
        "hourly": {"time": ["t0", "t1", "t2"], "temperature_2m": [1.5, None, 3]},
        "units": {"temperature_2m": "C"},
        "flags": [1],
    }
    got = _rows(feeds.records_table(feeds.expand_series(_payloads(spark, weather))).orderBy("time"))
    assert got == [
        {"latitude": 52.5, "temperature_2m": v, "time": t} for t, v in (("t0", 1.5), ("t1", None), ("t2", 3.0))
    ]


@pytest.mark.parametrize(
    "document",
    [
        {"hourly": {"a": [1, 2], "b": [1]}},
        {"hourly": {"a": [1], "b": [2]}},
        {"hourly": {"a": [1, 2], "b": 3}},
        {"hourly": {}},
        {"hourly": [1, 2]},
        {"weekly": {"a": [1, 2]}},
    ],
)
def test_shapes_that_do_not_expand(spark, document):
    df = _payloads(spark, document)
    assert feeds.expand_series(df).count() == 0
    assert feeds.plain_records(df).count() == 1


def test_first_key_wins_and_scalars_win(spark):
    both = {"daily": {"d": [1, 2]}, "hourly": {"h": [3, 4], "s": [5, 6]}, "s": "top"}
    got = _rows(feeds.records_table(feeds.expand_series(_payloads(spark, both))).orderBy("h"))
    assert got == [{"h": 3, "s": "top"}, {"h": 4, "s": "top"}]
    later = {"hourly": {"h": [1]}, "items": {"i": [7, 8]}}
    assert {r["i"] for r in _rows(feeds.records_table(feeds.expand_series(_payloads(spark, later))))} == {7, 8}


def test_flattening_and_unwrapping(spark):
    nested = {"a": {"b": {"c": 1}, "d": [1, 2]}, "e": "x"}
    table = feeds.records_table(feeds.plain_records(_payloads(spark, nested, "not json")))
    assert sorted(table.columns) == ["a.b.c", "a.d", "e"]
    assert _rows(feeds.stringify_complex(table)) == [{"a.b.c": 1, "a.d": "[1,2]", "e": "x"}]
    lists = [{"data": [{"v": 1}, {"v": 2}]}, {"results": [{"v": 3}]}, {"records": [{"v": 4}]}, [{"v": 5}], {"v": 6}]
    got = feeds.records_table(feeds.unwrap_records(_payloads(spark, *lists)))
    assert sorted(r["v"] for r in _rows(got)) == [1, 2, 3, 4, 5, 6]


def test_mixed_payloads_keep_all_records(spark):
    df = _payloads(spark, {"data": {"x": [1, 2, 3]}}, {"x": 9}, [{"x": 10}, {"x": 11}])
    got = feeds.records_table(feeds.feed_records(df))
    assert sorted(r["x"] for r in _rows(got)) == [1, 2, 3, 9, 10, 11]


def test_csv_payloads_and_counts(spark):
    text = 'id,note\r\n1,"a, b\nc"\r\n2,plain\r\n\r\n'
    df = _payloads(spark, text)
    assert _rows(feeds.csv_records(df, "id int, note string")) == [
        {"id": 1, "note": "a, b\nc"}, {"id": 2, "note": "plain"},
    ]
    odd = _payloads(spark, 'id,note\n1,p\x01q\x02r\n2,"a\x01\n""b"""\n3,5" pipe\n4,"x"y\n5,"open\nto the end')
    assert [r["note"] for r in _rows(feeds.csv_records(odd))] == [
        "p\x01q\x02r", 'a\x01\n"b"', '5" pipe', "xy", "open\nto the end",
    ]
    long = "é\n" * 20_000
    assert _rows(feeds.csv_records(_payloads(spark, f'a\n"{long}"\n'), "a string")) == [{"a": long}]
    rows = [(1, text, "csv"), (2, '{"hourly": {"t": [1, 2, 3]}}', "json"), (3, "[1, 2]", "json"), (4, "{}", "json"), (5, "{", "json"), (6, "x", "text")]
    counted = feeds.ingest_payloads(spark.createDataFrame(rows, "source_id int, payload string, snapshot_format string"))
    assert {r["source_id"]: r["records_count"] for r in counted.collect()} == {1: 2, 2: 3, 3: 2, 4: 1, 5: None, 6: None}


def test_whole_file_payloads(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "data": [{"v": 1},\n {"v": 2}]\n}')
    landed = feeds.read_payloads(spark, str(tmp_path), whole_files=True).select("payload")
    assert feeds.unwrap_records(landed).count() == 2


def test_stored_dataset_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.range(5)
    key = store.store_dataset(df, "d", root, datetime(2024, 1, 1))
    assert store.processed_data(spark, root, key) is None
    store.store_dataset(
        df, "d", root, datetime(2024, 1, 2), processed=df.where("id > 1"), quality_score=88.0,
        dataset_id=key, status="COMPLETED",
    )
    assert store.registry(spark, root).count() == 1
    assert store.registry(spark, root).first()["status"] == "COMPLETED"
    assert store.processed_data(spark, root, key).count() == 3
    assert store.original_data(spark, root, key).count() == 5
    assert store.original_data(spark, root, "nobody") is None


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", now', [1, 2]), (2, None, None)], "i int, t string, a array<int>")
    store.export(df, str(tmp_path / "o.csv"), "csv")
    assert _rows(files.read_csv(spark, str(tmp_path / "o.csv")).orderBy("i"))[0] == {"i": 1, "t": 'say "hi", now', "a": "[1,2]"}
    store.export_with_report(df, spark.range(1), str(tmp_path / "both"), "json")
    assert files.read_json(spark, str(tmp_path / "both" / "data")).count() == 2
    assert files.read_json(spark, str(tmp_path / "both" / "validation_report")).count() == 1
    with pytest.raises(ValueError):
        store.export(df, str(tmp_path / "x"), "xlsx")


def test_catalog_counts(spark):
    spark.range(7).createOrReplaceTempView("seven_rows")
    counts = {r["table_name"]: r["row_count"] for r in catalog.catalog_row_counts(spark).collect()}
    assert counts["seven_rows"] == 7
    assert catalog.import_table(spark, "seven_rows").count() == 7
    row = catalog.import_registration(spark.range(7), "dbo", "t", "20240101_000000").first()
    assert tuple(row) == ("dbo_t_import_20240101_000000", "PENDING", 7)
    with pytest.raises(ValueError, match="one task"):
        catalog.import_jdbc(spark, "jdbc:x", "t")


KEYS = [
    "i * i", "case when i % 3 = 0 then null else i end", "case when i < 900 then 7 else i end",
    "concat('o' || chr(39), i % 50)", "timestamp '2024-01-01' + to_seconds(i * 60)",
    "date '2024-01-01' + cast(i % 9 as int)", "7", "null::int", "i / 8",
]


@pytest.mark.parametrize("keys", KEYS)
def test_database_reads_are_cut_by_the_keys_of_the_table(keys):
    db = duckdb.connect()
    db.execute(f"create table t as select i, {keys} as k from range(1000) r(i)")
    cuts = [k for _, k in db.execute(catalog.cut_query("t", "k", 8)).fetchall()]
    parts = [db.execute(f"select i from t where {p}").fetchall() for p in catalog.range_predicates("k", cuts)]
    assert sorted(row for part in parts for row in part) == [(i,) for i in range(1000)]
    if keys in ("i * i", "i / 8") or keys.startswith("timestamp"):
        assert len(parts) == 8 and {len(p) for p in parts} == {125}


def test_sales_sample_equals_sql(spark):
    sql = """
    with d as (select i + 1 as OrderID, printf('CUST_%04d', i + 1) as CustomerID, printf('PROD_%03d', i % 20) as ProductID,
      timestamp '2025-01-01' + i * interval '1' day as OrderDate,
      case when i % 25 = 0 then null when i % 15 = 0 then 0e0 else (i % 50 + 1)::double end as Quantity,
      case when i % 30 <> 0 then round(i * 0.99e0 + 10, 2) else -round(i * 0.99e0 + 10, 2) end as UnitPrice,
      case when i % 20 = 0 then null else ['North', 'South', 'East', 'West'][i % 4 + 1] end as Region
      from range(500) t(i)) select * from d union all select * from d where OrderID <= 10 order by 1"""
    expected = duckdb.sql(sql).fetchall()
    got = [tuple(r) for r in samples.sales_sample(spark).orderBy("OrderID").collect()]
    assert got == expected and len(got) == 510


def test_random_samples_have_their_defects(spark):
    sales = samples.sales_records(spark, 20_000)
    row = sales.agg(
        F.avg(F.col("Quantity").isNull().cast("int")), F.avg(F.col("Region").isNull().cast("int")),
        F.avg((F.col("UnitPrice") < 0).cast("int")), F.avg((F.col("Quantity") == 0).cast("int")),
    ).first()
    assert [round(v, 2) for v in row] == [0.05, 0.03, 0.01, 0.02]
    assert sales.count() == 20_000
    assert samples.sales_records(spark, 100).collect() == samples.sales_records(spark, 100).collect()
    perf = samples.performance_records(spark, 50_000)
    assert 50_300 < perf.count() < 50_700 and len(perf.columns) == 7
    assert perf.count() - perf.distinct().count() == perf.count() - 50_000
    assert 0.015 < perf.where("age is null").count() / 50_000 < 0.025
