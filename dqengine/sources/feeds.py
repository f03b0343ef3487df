"""Feed payloads: JSON or CSV text to rows, and the snapshot store.

JSON payloads are read as VARIANT, so every payload is judged by its own shape and no
common schema is needed. Columns are found at the end by one distributed aggregation, or
given by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.functions.columns import col
from dqengine.operators.audit import latest_per_key
from dqengine.sources.files import MISSING_MARKERS, infer_types, type_ddl, variant_type, without_markers

# Keys searched for rows, in order.
SERIES_KEYS = ("hourly", "daily", "data", "results", "records", "items")
LIST_KEYS = ("data", "results", "records")


def read_payloads(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Landed payloads, one per line or one per file, as ``(payload, path)``."""
    reader = spark.read.option("wholetext", "true") if whole_files else spark.read
    return reader.text(path).select(
        F.col("value").alias("payload"), F.col("_metadata.file_path").alias("path")
    )


def _json(payload: Column) -> Column:
    return F.try_parse_json(payload)


def _series(document: Column, key: str, least: int) -> Column:
    """The object under a key if all its values are lists of one length, ``least`` or more, else NULL."""
    lists = F.try_variant_get(document, f"$.{key}", "map<string,array<variant>>")
    values = F.map_values(lists)
    same = F.forall(
        values, lambda a: a.isNotNull() & (F.size(a) >= least) & (F.size(a) == F.size(F.get(values, F.lit(0))))
    )
    return F.when((F.size(values) > 0) & same, lists)


def _scalars(document: Column, key: Column) -> Column:
    """Top-level fields that are neither objects nor lists, as a map of variants."""
    top = F.try_variant_get(document, "$", "map<string,variant>")

    def keep(name: Column, value: Column) -> Column:
        shape = F.schema_of_variant(value)
        return (name != key) & ~shape.startswith("ARRAY") & ~shape.startswith("OBJECT")

    return F.map_filter(top, keep)


def with_series(df: DataFrame, payload: str = "payload", least: int = 2) -> DataFrame:
    """Adds the parsed document, the first series found and the key it lies under.

    A series has ``least`` rows: lists of one value may also be plain lists.
    """
    document = F.col("__doc")
    found = [_series(document, k, least) for k in SERIES_KEYS]
    # The first that is one; the keys after it are not converted.
    first = F.coalesce(*[F.when(f.isNotNull(), F.struct(F.lit(k).alias("key"), f.alias("lists"))) for k, f in zip(SERIES_KEYS, found)])
    return df.withColumn("__doc", _json(F.col(payload))).withColumn("__series", first)


def expand_series(df: DataFrame, payload: str = "payload", least: int = 2) -> DataFrame:
    """One ``record`` (VARIANT) per position of a columnar payload.

    Scalar top-level fields are repeated on every record and win over a series of the same
    name; other objects and lists are dropped. Payloads without a series give no rows.
    """
    lists = F.col("__series.lists")
    length = F.size(F.get(F.map_values(lists), F.lit(0)))
    meta = _scalars(F.col("__doc"), F.col("__series.key"))
    own = F.map_filter(lists, lambda k, v: ~F.map_contains_key(F.col("__meta"), k))
    at = F.transform_values(own, lambda k, v: F.get(v, F.col("__i")))
    return (
        with_series(df, payload, least)
        .where("__series is not null")
        .withColumn("__meta", meta)
        .withColumn("__i", F.explode(F.sequence(F.lit(0), length - 1)))
        .withColumn("record", F.to_variant_object(F.map_concat(at, F.col("__meta"))))
        .drop("__doc", "__series", "__meta", "__i", payload)
    )


def plain_records(df: DataFrame, payload: str = "payload", least: int = 2) -> DataFrame:
    """One ``record`` per list element, or per payload, for payloads without a series."""
    document = F.col("__doc")
    whole = F.coalesce(F.try_variant_get(document, "$", "array<variant>"), F.array(document))
    return (
        with_series(df, payload, least)
        .where("__series is null and __doc is not null")
        .withColumn("record", F.explode(whole))
        .drop("__doc", "__series", payload)
    )


def feed_records(df: DataFrame, payload: str = "payload", least: int = 2) -> DataFrame:
    """Records of all payloads: series expanded, everything else one record per object."""
    return expand_series(df, payload, least).unionByName(plain_records(df, payload, least))


def rejected_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows whose payload cannot be read as JSON, with the ``reason``; no reader of records returns them."""
    reason = F.when(F.col(payload).isNull(), "no payload").when(F.trim(payload) == "", "empty payload")
    return df.where(_json(F.col(payload)).isNull()).withColumn("reason", F.coalesce(reason, F.lit("not JSON")))


def unwrap_records(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One ``record`` per element of the list under data, results or records.

    A payload that is itself a list gives its elements, any other object gives itself.
    """
    document = F.col("__doc")
    lists = [F.try_variant_get(document, "$", "array<variant>")]
    lists += [F.try_variant_get(document, f"$.{k}", "array<variant>") for k in LIST_KEYS]
    return (
        df.withColumn("__doc", _json(F.col(payload)))
        .where("__doc is not null")
        .withColumn("record", F.explode(F.coalesce(*lists, F.array(document))))
        .drop("__doc", payload)
    )


def _storable(kind: T.DataType) -> T.DataType:
    """Types of a table: what was never seen is text, and fractions are double where a double holds them."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _storable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_storable(kind.elementType))
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.DecimalType) and 0 < kind.scale and kind.precision <= 15:
        return T.DoubleType()
    return kind


def records_schema(df: DataFrame, record: str = "record") -> T.StructType:
    """Columns of the records, found by one aggregation over all of them."""
    shape = df.agg(F.schema_of_variant_agg(F.col(record)).alias("s")).first()["s"]
    if not shape or not shape.startswith("OBJECT<"):
        return T.StructType([T.StructField("value", T.VariantType())])
    return _storable(variant_type(shape))


def records_table(
    df: DataFrame, schema: str | T.StructType | None = None, record: str = "record"
) -> DataFrame:
    """Records as columns; nested objects become dotted columns, lists stay lists."""
    schema = records_schema(df, record) if schema is None else schema
    kind = f"struct<{schema}>" if isinstance(schema, str) else type_ddl(schema)
    struct = F.try_variant_get(F.col(record), "$", kind)
    others = [col(c) for c in df.columns if c != record]
    return flatten(df.select(*others, struct.alias("__r")), "__r")


def flatten(df: DataFrame, only: str | None = None) -> DataFrame:
    """Structs to dotted columns, at any depth; ``only`` drops that column's own name."""
    columns: list[Column] = []

    def leaves(source: Column, kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                leaves(source.getField(f.name), f.dataType, f"{name}.{f.name}" if name else f.name)
        else:
            columns.append(source.alias(name))

    for f in df.schema.fields:
        leaves(col(f.name), f.dataType, "" if f.name == only else f.name)
    return df.select(*columns)


def stringify_complex(df: DataFrame) -> DataFrame:
    """Arrays, maps, structs and variants as JSON text, for stores that hold plain cells."""
    complex_types = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return df.select(
        *[
            F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, complex_types) else col(f.name)
            for f in df.schema.fields
        ]
    )


# One field of a CSV text: quoted, up to its closing quote or the end, or anything that does not start with a quote.
_FIELD = r'(?:"(?:[^"]++|"")*+(?:"[^,\r\n]*+|\z)|[^",\r\n][^,\r\n]*+|)'
_RECORD = rf"({_FIELD}(?:,{_FIELD})*+)(?:\r?\n|\r|\z)"
_CELL = r',("(?:[^"]++|"")*+(?:"[^,]*+|\z)|[^,]*+)'
#: Payloads with more different cell names than this need a schema.
MOST_NAMES = 10_000


def _csv_lines(payload: Column) -> Column:
    """Records of a CSV text; a line break inside quotes does not end one."""
    return F.regexp_extract_all(payload, F.lit(_RECORD), F.lit(1))


def _csv_cells(line: Column) -> Column:
    """Cells of one CSV record, without their quotes; an empty cell without quotes is null."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CELL), F.lit(1))

    def inner(cell: Column) -> Column:
        """What stands in the quotes and after them; a doubled quote is one."""
        quoted = F.regexp_extract(cell, r'^"((?:[^"]++|"")*+)', 1)
        rest = cell.substr(F.length(quoted) + 3, F.length(cell))
        return F.concat(F.replace(quoted, F.lit('""'), F.lit('"')), rest)

    return F.transform(cells, lambda c: F.when(c.startswith('"'), inner(c)).when(c != "", c))


def csv_records(
    df: DataFrame, schema: str | T.StructType | None = None, payload: str = "payload"
) -> DataFrame:
    """Rows of CSV payloads, cells matched to columns by the header line of their own payload.

    ``schema`` names the columns wanted; one that a payload lacks is null there. Without it all names of all headers
    become columns, and types are found by one aggregation, as for an uploaded file.
    """
    others = [c for c in df.columns if c != payload]
    rows = (
        df.select(*map(col, others), _csv_lines(F.col(payload)).alias("__lines"))
        .select(*map(col, others), _csv_cells(F.get("__lines", F.lit(0))).alias("__names"), F.posexplode("__lines").alias("__line", "__text"))
        .where((F.col("__line") > 0) & (F.trim("__text") != ""))
        .withColumn("__cells", _csv_cells(F.col("__text")))
    )
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if schema is None:
        found = rows.select(F.explode("__names").alias("n")).where("n is not null").distinct().orderBy("n")
        found = found.limit(MOST_NAMES + 1).collect()
        if len(found) > MOST_NAMES:
            raise ValueError(f"More than {MOST_NAMES} different names in the headers; give a schema")
        kinds = {r.n: "string" for r in found}
    else:
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}

    def cell(name: str) -> Column:
        at = F.array_position("__names", F.lit(name)).cast("int")
        return F.when(at > 0, F.get("__cells", at - 1))

    values = [cell(n).try_cast(kind).alias(n) for n, kind in kinds.items()]
    if schema is not None:
        return rows.select(*map(col, others), *values)
    typed = infer_types(without_markers(rows.select(*values)))
    kinds = {f.name: f.dataType.simpleString() for f in typed.schema.fields}
    known = [
        F.when(~cell(n).isin(*MISSING_MARKERS), cell(n)).try_cast(kind).alias(n) for n, kind in kinds.items()
    ]
    return rows.select(*map(col, others), *known)


def decoded_snapshots(snapshots: DataFrame, schema: str) -> DataFrame:
    """Rows of stored payloads, each decoded by its own ``snapshot_format``: JSON of any shape, or CSV."""
    kind = F.lower("snapshot_format")
    drop = ("snapshot_format", "records_count")
    from_json = records_table(feed_records(snapshots.where(kind == "json").drop(*drop)), schema)
    return from_json.unionByName(csv_records(snapshots.where(kind == "csv").drop(*drop), schema))


def records_count() -> Column:
    """Number of rows a payload stands for; NULL if it cannot be read.

    Needs the columns of ``with_series`` and ``snapshot_format``.
    """
    document = F.col("__doc")
    series = F.size(F.get(F.map_values(F.col("__series.lists")), F.lit(0)))
    listed = F.size(F.try_variant_get(document, "$", "array<variant>"))
    as_json = F.when(F.col("__series").isNotNull(), series).when(
        document.isNotNull(),
        F.when(F.schema_of_variant(document).startswith("ARRAY"), listed).otherwise(1),
    )
    lines = F.size(F.filter(_csv_lines(F.col("payload")), lambda s: F.trim(s) != "")) - 1
    kind = F.lower("snapshot_format")
    return F.when(kind == "json", as_json).when(kind == "csv", lines).cast("long")


def ingest_payloads(df: DataFrame) -> DataFrame:
    """Snapshot rows from ``(source_id, payload, snapshot_format, fetched_at)``."""
    return with_series(df).withColumn("records_count", records_count()).drop("__doc", "__series")


def store_snapshots(snapshots: DataFrame, path: str) -> None:
    """Append snapshots; the last fetch of a source is derived from them."""
    snapshots.write.mode("append").parquet(path)


def last_fetched(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("source_id").agg(
        F.max("fetched_at").alias("last_fetch"), F.count("*").alias("snapshots")
    )


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of every source.

    ``max_by`` keeps one row per source and task, so a source with most of the snapshots
    is no hot spot.
    """
    whole = F.struct(*[col(c) for c in snapshots.columns])
    order = F.struct("fetched_at", "snapshot_id")
    return (
        snapshots.groupBy(F.col("source_id").alias("__source"))
        .agg(F.max_by(whole, order).alias("__row"))
        .select("__row.*")
    )


def recent_snapshots(snapshots: DataFrame, limit: int = 10) -> DataFrame:
    """The newest snapshots of every source, without their payload."""
    return latest_per_key(
        snapshots.drop("payload"), "source_id", ["fetched_at", "snapshot_id"], limit
    )
