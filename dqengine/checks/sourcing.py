"""Registered queries of sources and sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from dqengine.checks.registry import check
from dqengine.checks.sql import VIEWS, issues_cte, score
from dqengine.operators.profile import find_issues, quality_report
from dqengine.session import scratch_path
from dqengine.sources import catalog, feeds, files, store
from dqengine.sources.views import BASE_TABLES, table

LI, EV, DOC = VIEWS
GROUP = 24


def _register(spark, d):
    for name in BASE_TABLES:
        table(spark, d, name).createOrReplaceTempView(name)


@check(
    "s01_csv_round_trip",
    (),
    "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer",
)
def s01(spark, d):
    path = scratch_path(spark, "customer") + ".csv"
    store.export(table(spark, d, "customer"), path, "csv")
    return files.read_csv(spark, path)


@check("s01_csv_documents", (), "select doc_id, text, lang, source, n_chars from documents")
def s01_documents(spark, d):
    path = scratch_path(spark, "documents") + ".csv"
    store.export(table(spark, d, "documents"), path, "csv")
    return files.read_table(spark, path)


@check("s01_csv_conversations", (), "select conv_id, turn, role, text from conversations")
def s01_conversations(spark, d):
    path = scratch_path(spark, "conversations") + ".csv"
    store.export(table(spark, d, "conversations"), path, "csv")
    return files.read_table(spark, path)


@check(
    "s01_csv_codes",
    (),
    "select p_partkey, concat(p_size, 'D') as code, cast(p_size as double) + 0.5e0 as number from part",
)
def s01_codes(spark, d):
    path = scratch_path(spark, "codes") + ".csv"
    code = F.concat(F.col("p_size").cast("string"), F.lit("D")).alias("code")
    number = (F.col("p_size").cast("double") + 0.5).alias("number")
    store.export(table(spark, d, "part").select("p_partkey", code, number), path, "csv")
    return files.read_table(spark, path)


@check("s02_json_documents", (), "select doc_id, text, lang, source, n_chars from documents")
def s02_documents(spark, d):
    path = scratch_path(spark, "documents") + ".json"
    store.export(table(spark, d, "documents"), path, "json")
    return files.read_table(spark, path)


@check("s02_mixed_folder", (), "select s_suppkey, s_name from supplier union all select c_custkey, c_name from customer")
def s02_mixed(spark, d):
    """A folder with JSON lines and with files that are one array."""
    path = scratch_path(spark, "mixed")
    store.export(table(spark, d, "supplier").select("s_suppkey", "s_name"), path, "json")
    customers = table(spark, d, "customer").select(
        (F.col("c_custkey") % 4).alias("part"), F.struct(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name")).alias("r")
    )
    lists = customers.groupBy("part").agg(F.to_json(F.collect_list("r")).alias("value")).repartition(4, "part")
    lists.select("value").write.mode("append").text(path)
    return files.read_json(spark, path)


@check(
    "s01_csv_folder_of_headers",
    (),
    "select o_orderkey, o_orderstatus, case when o_orderkey % 3 = 2 then o_totalprice end as o_totalprice, "
    "case when o_orderkey % 3 = 1 then concat('two', chr(10), 'lines') end as note from orders",
)
def s01_headers(spark, d):
    """Three kinds of files in one folder: two orders of the same columns, and columns of their own, also in quotes."""
    path = scratch_path(spark, "headers") + ".csv"
    orders = table(spark, d, "orders").withColumn("note", F.lit("two\nlines"))
    columns = (["o_orderkey", "o_orderstatus"], ["note", "o_orderstatus", "o_orderkey"], ["o_totalprice", "o_orderkey", "o_orderstatus"])
    for i, names in enumerate(columns):
        part = orders.where(F.col("o_orderkey") % 3 == i).select(*names)
        store.export(part, path, "csv") if i == 0 else part.write.mode("append").options(header="true", escape='"').csv(path)
    return files.read_table(spark, path)


def _some_broken(spark, d, path):
    """Orders as JSON lines, every seventh cut off in the middle."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    line = F.to_json(F.struct(*orders.columns))
    cut = F.when(F.col("o_orderkey") % 7 == 0, F.left(line, F.lit(12))).otherwise(line)
    orders.select(cut.alias("value")).write.text(path)


@check("s02_json_broken_lines", (), "select o_orderkey, o_totalprice from orders where o_orderkey % 7 <> 0")
def s02_broken(spark, d):
    path = scratch_path(spark, "broken")
    _some_broken(spark, d, path)
    return files.read_json(spark, path).select("o_orderkey", "o_totalprice")


@check(
    "s02_json_rejected_lines",
    (),
    "select '{\"o_orderkey' as text, 'not JSON' as reason, count(*) as n from orders where o_orderkey % 7 = 0 having count(*) > 0",
)
def s02_rejected(spark, d):
    path = scratch_path(spark, "broken")
    _some_broken(spark, d, path)
    return files.rejected_json(spark, path).groupBy("text", "reason").agg(F.count("*").alias("n"))


@check("s02_json_array_documents", (), "select doc_id, text, lang from documents")
def s02_arrays(spark, d):
    """Files that are one array of objects, some on one line and some with a line for each field."""
    path = scratch_path(spark, "arrays")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    for part, glue in ((0, ","), (1, ",\n")):
        record = F.to_json(F.struct("doc_id", "text", "lang"))
        mine = docs.where(F.pmod("doc_id", F.lit(2)) == part).groupBy(F.pmod("doc_id", F.lit(8)).alias("file"))
        text = mine.agg(F.concat(F.lit("[\n" if part else "["), F.array_join(F.collect_list(record), glue), F.lit("]")).alias("value"))
        text.repartition("file").write.mode("append").partitionBy("file").text(path)
    return files.read_json(spark, path)


@check(
    "s01_csv_missing_values",
    (LI,),
    f"select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_quantity, l_returnflag, l_linestatus from {LI}",
)
def s01_missing(spark, d):
    path = scratch_path(spark, "lines") + ".csv"
    lines = table(spark, d, LI).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"
    )
    store.export(lines, path, "csv")
    return files.read_csv(spark, path)


@check("s02_json_round_trip", (), "select s_suppkey, s_name, cast(s_nationkey as bigint) as s_nationkey, s_acctbal from supplier")
def s02(spark, d):
    path = scratch_path(spark, "supplier") + ".json"
    store.export(table(spark, d, "supplier"), path, "json")
    return files.read_json(spark, path)


@check(
    "s03_read_by_extension",
    (),
    "select 'csv' as format, count(*) as n, cast(sum(o_orderkey) as bigint) as key_sum from orders union all "
    "select 'json', count(*), cast(sum(o_orderkey) as bigint) from orders",
)
def s03(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    parts = []
    for kind in ("csv", "json"):
        path = scratch_path(spark, "orders") + f".{kind}"
        store.export(orders, path, kind)
        read = files.read_table(spark, path)
        parts.append(
            read.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum")).select(
                F.lit(kind).alias("format"), "n", "key_sum"
            )
        )
    return parts[0].unionAll(parts[1])


@check("s04_imported_table", (), "select * from part")
def s04(spark, d):
    _register(spark, d)
    return catalog.import_table(spark, "part")


@check(
    "s04_import_registration",
    (),
    "select 'main_part_import_20240131_000000' as dataset_name, 'PENDING' as status, count(*) as processed_rows from part",
)
def s04_registration(spark, d):
    _register(spark, d)
    part = catalog.import_table(spark, "part")
    return catalog.import_registration(part, "main", "part", "20240131_000000")


@check(
    "s05_table_row_counts",
    (),
    " union all ".join(
        f"select 'default' as schema_name, '{t}' as table_name, count(*) as row_count from {t}" for t in BASE_TABLES
    ),
)
def s05(spark, d):
    _register(spark, d)
    return catalog.table_row_counts(spark, BASE_TABLES)


@check(
    "s05_catalogue_totals",
    (),
    "select r_name as schema_name, n_name as table_name, cast(sum(o_orderkey) as bigint) as row_count from region "
    "join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by all",
)
def s05_totals(spark, d):
    schemas = table(spark, d, "region").select(
        F.col("r_regionkey").alias("schema_id"), F.col("r_name").alias("schema_name")
    )
    tables = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("table_id"),
        F.col("n_name").alias("table_name"),
        F.col("n_regionkey").alias("schema_id"),
    )
    owner = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("table_id")
    )
    partitions = table(spark, d, "orders").join(owner, "o_custkey").select(
        "table_id", F.col("o_orderkey").alias("rows")
    )
    return catalog.catalogue_totals(schemas, tables, partitions)


def _grouped(events):
    """At most 24 consecutive events per payload, as sorted lists."""
    rows = F.array_sort(F.collect_list(F.struct("event_id", "ts", "value", "event_type")))
    return events.groupBy(F.floor(F.col("event_id") / GROUP).alias("group_id")).agg(rows.alias("r"))


def _columnar(spark, d):
    """Columnar payloads; they also carry a scalar, an object and a list at top level."""
    grouped = _grouped(table(spark, d, "events"))
    series = F.struct(
        F.col("r.event_id").alias("event_id"),
        F.transform("r", lambda x: F.date_format(x["ts"], "yyyy-MM-dd HH:mm:ss")).alias("time"),
        F.col("r.value").alias("value"),
    )
    body = F.struct(
        "group_id",
        F.lit("C").alias("unit"),
        F.struct(F.lit(1).alias("x")).alias("meta"),
        F.array(F.lit(1), F.lit(2)).alias("tags"),
    )
    hourly = F.to_json(F.struct(body["group_id"].alias("group_id"), body["unit"].alias("unit"), body["meta"].alias("meta"), body["tags"].alias("tags"), series.alias("hourly")))
    items = F.to_json(F.struct(body["group_id"].alias("group_id"), body["unit"].alias("unit"), series.alias("items")))
    return grouped.select(
        "group_id", F.when(F.col("group_id") % 2 == 0, hourly).otherwise(items).alias("payload")
    )


SIZES = "g as (select event_id // 24 as group_id, count(*) as c from events group by 1)"


@check(
    "s06_ingested_payloads",
    (),
    f"with {SIZES} select group_id as source_id, 'json' as snapshot_format, case when c > 1 then c else 1 end as records_count from g "
    "union all select group_id, 'csv', c from g",
)
def s06(spark, d):
    fetched = F.lit("2024-01-30 12:00:00").cast("timestamp")
    json_payloads = _columnar(spark, d).select(
        F.col("group_id").alias("source_id"), "payload", F.lit("json").alias("snapshot_format"), fetched.alias("fetched_at")
    )
    csv_payloads = _csv_payloads(spark, d).select(
        F.col("group_id").alias("source_id"), "payload", F.lit("csv").alias("snapshot_format"), fetched.alias("fetched_at")
    )
    path = scratch_path(spark, "snapshots")
    feeds.store_snapshots(feeds.ingest_payloads(json_payloads.unionByName(csv_payloads)), path)
    return spark.read.parquet(path).select("source_id", "snapshot_format", "records_count")


@check(
    "s07_expanded_series",
    (),
    f"with {SIZES} select group_id, 'C' as unit, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as time, value "
    "from events join g on event_id // 24 = group_id where c > 1",
)
def s07(spark, d):
    path = scratch_path(spark, "landed")
    _columnar(spark, d).select("payload").write.text(path)
    landed = feeds.read_payloads(spark, path).select("payload")
    return feeds.records_table(feeds.expand_series(landed))


@check(
    "s08_flattened_objects",
    (),
    'select event_id, user_id as "user.id", cast(json_extract(props, \'$.k\') as bigint) as "user.props.k", value from events',
)
def s08(spark, d):
    user = F.struct(
        F.col("user_id").alias("id"), F.from_json("props", "k bigint").alias("props")
    )
    payloads = table(spark, d, "events").select(
        F.to_json(F.struct("event_id", user.alias("user"), "value")).alias("payload")
    )
    return feeds.records_table(feeds.plain_records(payloads))


@check("s08_awkward_records", (), "select event_id as \"VOID\", event_id + 9007199254740992 as \"a b\", cast(null as varchar) as never from events")
def s08_awkward(spark, d):
    fields = [F.col("event_id").alias("VOID"), (F.col("event_id") + 9007199254740992).alias("a b"), F.lit(None).cast("string").alias("never")]
    payloads = table(spark, d, "events").select(
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload")
    )
    return feeds.records_table(feeds.plain_records(payloads))


@check("s08_rejected_payloads", (), "select event_id, 'not JSON' as reason from events where event_id % 7 = 0")
def s08_rejected(spark, d):
    broken = F.when(F.col("event_id") % 7 == 0, F.lit("{\"k\": ")).otherwise(F.col("props"))
    payloads = table(spark, d, "events").select("event_id", broken.alias("payload"))
    return feeds.rejected_payloads(payloads).drop("payload")


@check("s09_unwrapped_records", (), "select event_id, value from events")
def s09(spark, d):
    grouped = _grouped(table(spark, d, "events"))
    rows = F.transform("r", lambda x: F.struct(x["event_id"].alias("event_id"), x["value"].alias("value")))
    shapes = [F.to_json(F.struct(rows.alias(k))) for k in feeds.LIST_KEYS] + [F.to_json(rows)]
    which = F.col("group_id") % 5
    payload = F.when(which == 4, F.lit(None))
    for i, text in enumerate(shapes):
        payload = F.when(which == i, text).otherwise(payload)
    lists = grouped.select(payload.alias("payload")).where("payload is not null")
    single = table(spark, d, "events").where(F.floor(F.col("event_id") / GROUP) % 5 == 4)
    objects = single.select(F.to_json(F.struct("event_id", "value")).alias("payload"))
    return feeds.records_table(feeds.unwrap_records(lists.unionByName(objects)))


@check(
    "s10_stringified_columns",
    (),
    "select event_id, to_json([event_id, user_id])::varchar as pair, to_json({'kind': event_type, 'user': user_id})::varchar as detail from events",
)
def s10(spark, d):
    events = table(spark, d, "events").select(
        "event_id",
        F.array("event_id", "user_id").alias("pair"),
        F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")).alias("detail"),
    )
    return feeds.stringify_complex(events)


def _csv_payloads(spark, d):
    line = F.transform(
        "r",
        lambda x: F.concat(
            x["event_id"].cast("string"), F.lit(","), x["event_type"], F.lit(',"a, b\nline 2",'), x["value"].cast("string")
        ),
    )
    text = F.concat(F.lit("event_id,event_type,note,value\n"), F.array_join(line, "\n"), F.lit("\n"))
    return _grouped(table(spark, d, "events")).select("group_id", text.alias("payload"))


@check(
    "s11_csv_payload_rows",
    (),
    "select event_id // 24 as group_id, event_id, event_type, concat('a, b', chr(10), 'line 2') as note, value from events",
)
def s11(spark, d):
    schema = "event_id bigint, event_type string, note string, value double"
    return feeds.csv_records(_csv_payloads(spark, d), schema)


@check(
    "s12_latest_snapshots",
    ("feed_snapshots",),
    "select snapshot_id, source_id, cast(json_extract(payload, '$.k') as bigint) as k, fetched_at from feed_snapshots "
    "qualify row_number() over (partition by source_id order by fetched_at desc, snapshot_id desc) = 1",
)
def s12(spark, d):
    latest = feeds.latest_snapshots(table(spark, d, "feed_snapshots"))
    return feeds.records_table(
        feeds.unwrap_records(latest.drop("snapshot_format", "records_count"))
    )


@check(
    "s12_decoded_snapshots",
    ("feed_snapshots",),
    "select snapshot_id, source_id, cast(json_extract(payload, '$.k') as bigint) as k, fetched_at from feed_snapshots "
    "qualify row_number() over (partition by source_id order by fetched_at desc, snapshot_id desc) = 1",
)
def s12_decoded(spark, d):
    """Half of the snapshots are CSV, with the wanted column after another one."""
    as_csv = F.col("snapshot_id") % 2 == 0
    k = F.get_json_object("payload", "$.k")
    mixed = table(spark, d, "feed_snapshots").withColumns(
        {
            "payload": F.when(as_csv, F.concat(F.lit("other,k\nx,"), k)).otherwise(F.col("payload")),
            "snapshot_format": F.when(as_csv, "CSV").otherwise("json"),
        }
    )
    return feeds.decoded_snapshots(feeds.latest_snapshots(mixed), "k bigint")


@check(
    "s13_recent_snapshots",
    ("feed_snapshots",),
    "select snapshot_id, source_id, snapshot_format, records_count, fetched_at, cast(row_number() over "
    "(partition by source_id order by fetched_at desc, snapshot_id desc) as integer) as recency from feed_snapshots qualify recency <= 10",
)
def s13(spark, d):
    return feeds.recent_snapshots(table(spark, d, "feed_snapshots"))


@check(
    "s14_last_fetched",
    ("feed_snapshots",),
    "select source_id, max(fetched_at) as last_fetch, count(*) as snapshots from feed_snapshots group by 1",
)
def s14(spark, d):
    path = scratch_path(spark, "snapshot-store")
    feeds.store_snapshots(table(spark, d, "feed_snapshots"), path)
    return feeds.last_fetched(spark.read.parquet(path))


@check(
    "s15_stored_dataset",
    (EV,),
    f"select 'events' as dataset_name, 'PROCESSING' as status, 0e0 as quality_score, count(*) as processed_rows from {EV}",
)
def s15(spark, d):
    root = scratch_path(spark, "store")
    store.store_dataset(table(spark, d, EV), "events", root, datetime(2024, 1, 31))
    return store.registry(spark, root).select("dataset_name", "status", "quality_score", "processed_rows")


@check(
    "s16_read_back",
    (EV,),
    f"select 'original' as copy, * from {EV} union all select 'processed', * from (select distinct * from {EV})",
)
def s16(spark, d):
    root = scratch_path(spark, "store")
    events = table(spark, d, EV)
    dataset = store.store_dataset(
        events, "events", root, datetime(2024, 1, 31), processed=events.dropDuplicates()
    )
    original = store.original_data(spark, root, dataset).withColumn("copy", F.lit("original"))
    processed = store.processed_data(spark, root, dataset).withColumn("copy", F.lit("processed"))
    return original.unionByName(processed)


def _labeled_texts(spark, d):
    return table(spark, d, DOC).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


@check("s17_exported_csv", (DOC,), f"select l.doc_id, d.text, l.lang, l.source, l.n_chars, cast(quality as bigint) as quality, cast(toxic as bigint) as toxic from {DOC} l join documents d on l.doc_id = d.doc_id")
def s17(spark, d):
    path = scratch_path(spark, "export") + ".csv"
    store.export(_labeled_texts(spark, d), path, "csv")
    return files.read_csv(spark, path)


@check("s17_exported_json", (DOC,), f"select l.doc_id, d.text, l.lang, l.source, l.n_chars, cast(quality as bigint) as quality, cast(toxic as bigint) as toxic from {DOC} l join documents d on l.doc_id = d.doc_id")
def s17_json(spark, d):
    path = scratch_path(spark, "export") + ".json"
    store.export(_labeled_texts(spark, d), path, "json")
    return files.read_json(spark, path)


@check(
    "s18_export_with_report",
    (DOC,),
    f"with {issues_cte(DOC)} select 'documents' as dataset_name, max(total_rows) as total_records, count(*) as issue_count, "
    f"round({score()}, 4) as quality_score, (select count(*) from {DOC}) as exported_rows from issues",
)
def s18(spark, d):
    path = scratch_path(spark, "bundle")
    documents = table(spark, d, DOC)
    report = quality_report(documents, "documents", find_issues(documents))
    store.export_with_report(documents, report, path, "json")
    written = files.read_json(spark, f"{path}/data").agg(F.count("*").alias("n")).scalar()
    return files.read_json(spark, f"{path}/validation_report").select(
        "dataset_name",
        "total_records",
        "issue_count",
        F.round(F.col("quality_score").cast("double"), 4).alias("quality_score"),
        written.alias("exported_rows"),
    )


@check("s22_preview", (), "select * from orders order by o_orderdate, o_orderkey limit 10")
def s22(spark, d):
    return files.preview(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 10)
