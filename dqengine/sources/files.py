"""Uploaded files: CSV and JSON, with the type and missing-value rules of an upload."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from dqengine.functions.columns import col
from dqengine.session import materialize

# Texts that mean "missing" in an uploaded CSV file.
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
UNSUPPORTED = ("xlsx", "xlsm", "xls")


# A number as it is written; Java's suffixes (10D, 20F) and hexadecimal forms are codes, not numbers.
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|inf|infinity)\s*$"


def infer_types(df: DataFrame) -> DataFrame:
    """Types found by one aggregation over all rows: whole numbers, numbers, booleans, text."""
    checks: list[Column] = []
    for i, c in enumerate(df.columns):
        value = col(c)
        checks += [
            F.count(value).alias(f"n{i}"),
            F.count_if(value.rlike(WHOLE) & value.try_cast("bigint").isNotNull()).alias(f"i{i}"),
            F.count_if(value.rlike(NUMBER) & value.try_cast("double").isNotNull()).alias(f"d{i}"),
            F.count_if(value.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}"),
        ]
    found = df.agg(*checks).first()
    columns = []
    for i, c in enumerate(df.columns):
        n = found[f"n{i}"]
        kind = "string"
        if n and found[f"i{i}"] == n:
            kind = "bigint"
        elif n and found[f"d{i}"] == n:
            kind = "double"
        elif n and found[f"b{i}"] == n:
            kind = "boolean"
        columns.append(col(c).cast(kind).alias(c))
    return df.select(*columns)


def without_markers(df: DataFrame) -> DataFrame:
    """Texts that mean "missing" as null."""
    return df.select(*[F.when(~col(c).isin(*MISSING_MARKERS), col(c)).alias(c) for c in df.columns])


# One field of a CSV line: in quotes with whatever follows them, or anything that does not start with a quote.
_FIELD = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|)'
#: A line that leaves no quotes open: read from its start, and read from inside quotes.
CLOSED = rf"^{_FIELD}(?:,{_FIELD})*+$"
CLOSES = rf'^(?:[^"]++|"")*+"[^,]*+(?:,{_FIELD})*+$'
#: Files with more different headers than this are no table.
MOST_HEADERS = 10_000


def _lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """All pieces between separators, with their ``file``, ``block`` (where its part of the file starts) and order.

    Spark cuts the same files into the same parts on every scan, so ``seq`` names a line in later scans too.
    """
    return spark.read.option("lineSep", separator).text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


def _ended(line: str) -> Column:
    """A line without the carriage return before its line feed."""
    return F.regexp_replace(line, "\r$", "")


def _csv_files(lines: DataFrame, multi_line: bool | None) -> DataFrame:
    """For each file: its first line and where it is, whether it is UTF-8, and whether quotes span lines."""
    line = _ended("value")
    written = F.when(F.trim(line) != "", F.struct("seq", "value"))  # the bytes as they are
    opens = F.contains("value", F.lit('"')) & ~line.rlike(CLOSED)
    found = lines.groupBy("file").agg(
        F.min(written).alias("head"),
        (F.count_if(~F.is_valid_utf8("value")) > 0).alias("foreign"),
        (F.count_if(opens) > 0).alias("open") if multi_line is None else F.lit(multi_line).alias("open"),
    )
    text = _decoded("head.value", "foreign")
    return found.where("head is not null").select(
        "file", F.col("head.seq").alias("at"), F.regexp_replace(text, "^\ufeff|\r$", "").alias("header"), "foreign",
        F.col("open").alias("quoted"),
    )


def _decoded(text: str, foreign: str) -> Column:
    """Text whose bytes are ISO-8859-1 where ``foreign`` says so."""
    return F.when(F.col(foreign), F.decode(F.col(text).cast("binary"), "ISO-8859-1")).otherwise(F.col(text))


def _across_parts(pieces: DataFrame, separator: str) -> DataFrame:
    """Pieces put together from one that ``starts`` up to the next: ``file``, ``seq`` of the first piece, ``text``.

    Every part of a file joins its own pieces; only the first and the last text of each part meet those of other parts.
    """

    own = Window.partitionBy("file", "block")
    upto = own.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumn("number", F.sum(F.col("starts").cast("int")).over(upto))
    pieces = pieces.withColumn("last", F.max("number").over(own))
    texts = pieces.groupBy("file", "block", "number", "last").agg(F.min("seq").alias("seq"), _in_order("value", separator))
    inner = texts.where("0 < number and number < last").select("file", "seq", "text")
    return inner.union(_crossing(texts.where("number = 0 or number = last"), separator))


def _in_order(text: str, separator: str) -> Column:
    """Texts of a group put together by ``seq``."""
    held = F.sort_array(F.collect_list(F.struct("seq", text)))
    return F.array_join(F.transform(held, lambda s: s[text]), separator).alias("text")


def _crossing(edges: DataFrame, separator: str) -> DataFrame:
    """Texts that cross from one part of a file into the next, out of the first and the last text of each part."""
    order = Window.partitionBy("file").orderBy("block", "number")
    edges = edges.withColumn("record", F.sum((F.col("number") > 0).cast("int")).over(order))
    crossing = edges.groupBy("file", "record").agg(F.min("seq").alias("seq"), _in_order("text", separator))
    return crossing.select("file", "seq", "text")


def _joined_records(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines put together where quotes span them: ``file``, ``seq`` of the first line, and ``text`` of each record.

    Whether a line starts inside quotes depends on all before it. Every line either leaves that as it is, turns it
    round, or settles it, and so does every part of a file: all parts are summed up in parallel, and the state is
    passed on over the few parts of a file. Then every task that reads a part puts its records together as it goes:
    lines come in the order of the file there, so none is sorted or moved. Only the first and the last text of each
    part, ``edges``, meet those of other parts. ``files`` are those to read.
    """
    quote, line = F.contains("value", F.lit('"')), _ended("value")
    # The state after the line if it starts outside quotes, and if it starts inside them; 1 is inside.
    outside = F.when(quote & ~line.rlike(CLOSED), 1).otherwise(0)
    inside = F.when(quote & line.rlike(CLOSES), 0).otherwise(1)
    # Broadcast, since other joins would take the lines out of their order.
    held = lines.join(F.broadcast(files.select("file")), "file")
    marked = held.select("file", "block", "seq", F.col("value").cast("binary").alias("value"), outside.alias("o"), inside.alias("i"))
    ends, records = _line_joiners()
    parts = marked.select("file", "block", "o", "i").mapInArrow(ends, "file string, block long, o int, i int")
    parts = parts.select(
        "file", "block",
        F.when(F.col("o") == F.col("i"), F.col("o")).alias("settled"),
        F.when(F.col("o") > F.col("i"), 1).otherwise(0).alias("turned"),
    )
    parts = _states(parts, Window.partitionBy("file").orderBy("block"))
    enters = ((F.coalesce("before_settled", F.lit(0)) + F.col("before_turned")) % 2).cast("int").alias("enters")
    parts = materialize(parts.select("file", "block", enters), "csv-parts")
    marked = marked.join(F.broadcast(parts), ["file", "block"])
    texts = marked.mapInArrow(records, "file string, block long, number long, seq long, edge boolean, text binary")
    edges = materialize(texts.where("edge").drop("edge"), "csv-edges").withColumn("text", F.col("text").cast("string"))
    inner = texts.where("not edge").select("file", "seq", F.col("text").cast("string").alias("text"))
    return inner.union(_crossing(edges, "\n"))


def _line_joiners() -> tuple[Callable, Callable]:
    """What tasks do with the lines of their parts of files; it is sent to them as it is, so it names nothing of here."""

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
        """Where the lines of each part are: the part, from, up to."""
        file, block, n = batch.column("file"), batch.column("block"), batch.num_rows
        other = [pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in (file, block)]
        bounds = [0, *(np.flatnonzero(other[0] | other[1]) + 1).tolist(), n] if n else []
        for start, end in zip(bounds, bounds[1:]):
            yield (file[start].as_py(), block[start].as_py()), start, end

    def states(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column("o").to_numpy(), batch.column("i").to_numpy()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part, the state after it if it starts outside quotes, and if it starts inside them."""

        def row(part: tuple[str, int], state: tuple[int, int]) -> pa.RecordBatch:
            columns = zip("file block o i".split(), (*part, *state), (pa.string(), pa.int64(), pa.int32(), pa.int32()))
            return pa.record_batch({name: pa.array([value], kind) for name, value, kind in columns})

        at, state = None, (0, 1)
        for batch in batches:
            o, i = states(batch)
            for part, start, end in runs(batch):
                if part != at:
                    if at is not None:
                        yield row(at, state)
                    at, state = part, (0, 1)
                a, b = o[start:end], i[start:end]
                settled = np.flatnonzero(a == b)
                if settled.size:
                    state = (int(a[settled[-1]]),) * 2
                    a, b = a[settled[-1] + 1 :], b[settled[-1] + 1 :]
                turned = int(np.count_nonzero(a > b)) % 2
                state = (state[0] ^ turned, state[1] ^ turned)
        if at is not None:
            yield row(at, state)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of each part, numbered from 0, the text before the first start; that and the last text are edges."""
        at, inside, number, first, held = None, 0, 0, 0, []
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        names = ("file", "block", "number", "seq", "edge", "text")
        kind, rows = pa.binary(), []

        def found() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (*kinds, kind))], names)

        for batch in batches:
            (o, i), values, kind = states(batch), batch.column("value").to_pylist(), batch.column("value").type
            seqs, enters = batch.column("seq").to_numpy(), batch.column("enters").to_numpy()
            rows = []
            for part, start, end in runs(batch):
                if part != at:
                    if held:
                        rows.append((*at, number, first, True, b"\n".join(held)))
                    at, inside, number, first, held = part, int(enters[start]), 0, int(seqs[start]), []
                a, b = o[start:end], i[start:end]
                settled = np.maximum.accumulate(np.where(a == b, np.arange(end - start), -1))
                turns = np.cumsum(a > b)
                since = turns - np.where(settled < 0, 0, turns[settled])
                after = (np.where(settled < 0, inside, a[settled]) + since) % 2
                starts = start + np.flatnonzero(np.append(inside, after[:-1]) == 0)
                inside, upto = int(after[-1]), start
                for next_start in starts.tolist():
                    held += values[upto:next_start]
                    if held:
                        rows.append((*at, number, first, number == 0, b"\n".join(held)))
                    number, first, held, upto = number + 1, int(seqs[next_start]), [], next_start
                held += values[upto:end]
            if rows:
                yield found()
        if held:
            rows = [(*at, number, first, True, b"\n".join(held))]
            yield found()

    return ends, records


def _states(rows: DataFrame, order: WindowSpec) -> DataFrame:
    """For the rows before each row, and for those up to it: the last ``settled`` state, and the turns since, 0 or 1."""
    through = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("turns_at", F.when(F.col("settled").isNotNull(), F.sum("turned").over(through)))
    columns = {}
    for name, frame in (("before", order.rowsBetween(Window.unboundedPreceding, -1)), ("after", through)):
        since = F.sum("turned").over(frame) - F.coalesce(F.last("turns_at", ignorenulls=True).over(frame), F.lit(0))
        columns[f"{name}_settled"] = F.last("settled", ignorenulls=True).over(frame)
        columns[f"{name}_turned"] = F.coalesce(since, F.lit(0)) % 2
    return rows.withColumns(columns)


def _header_names(header: str) -> list[str]:
    """Names in a header line; one without a name is ``_c`` and its position, a repeated one has its number after it."""
    cells = next(csv.reader(io.StringIO(header), strict=False), [])
    names: list[str] = []
    for i, cell in enumerate(cells):
        name, n = cell or f"_c{i}", 0
        while name in names:
            n += 1
            name = f"{cell or f'_c{i}'}.{n}"
        names.append(name)
    return names


def read_csv(
    spark: SparkSession, path: str, schema: str | None = None, multi_line: bool | None = None
) -> DataFrame:
    """CSV files, each read by its own header line; columns meet by name.

    One scan judges all files: their first line, lines that are not valid UTF-8 (such a file is ISO-8859-1), and lines
    that leave quotes open. Files with one header and no line breaks in quotes are read by Spark as they are. Others
    are read as lines, also split: records of several lines are put together (``_joined_records``), and the cells of
    each record go to the columns its file names. ``multi_line`` says whether quotes span lines, instead of looking.

    Texts that mean "missing" are null. Types are those of ``schema``, which then also chooses the columns (cells of
    another type are null), or are found by one aggregation. Blank lines are no rows. Rows come in no certain order.
    """
    lines = _lines(spark, path)
    files = materialize(_csv_files(lines, multi_line), "csv-files")
    headers = _headers(lines, files)
    if not headers:
        return spark.createDataFrame([], schema or T.StructType([]))
    kinds = files.select("foreign", "quoted").distinct().collect()
    if len(headers) == len(kinds) == 1 and not kinds[0].quoted:
        strings = T.StructType([T.StructField(n, T.StringType()) for n in _header_names(headers[0][0])])
        encoding = "ISO-8859-1" if kinds[0].foreign else "UTF-8"
        raw = spark.read.schema(strings).options(header="true", encoding=encoding, escape='"').csv(path)
    else:
        raw = _cells_by_header(lines, files, headers)
    if not raw.columns:
        return raw
    if schema is None:
        return infer_types(without_markers(raw))
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    absent = {f.name: F.lit(None).cast("string") for f in wanted.fields if f.name not in raw.columns}
    cells = without_markers(raw.withColumns(absent).select(*[col(f.name) for f in wanted.fields]))
    return cells.select(*[col(f.name).try_cast(f.dataType.simpleString()).alias(f.name) for f in wanted.fields])


def _headers(lines: DataFrame, files: DataFrame) -> list[tuple[str, list[str]]]:
    """Different header records, each with its first line."""
    plain = files.where(F.col("header").rlike(CLOSED)).select("header", F.col("header").alias("line"))
    # A header may span lines itself: then the whole record is the header of the files that begin with its first line.
    spans = files.where(~F.col("header").rlike(CLOSED)).select("file", "at", "header", "foreign")
    if not spans.isEmpty():
        whole = _joined_records(lines, spans).join(spans, "file").where("seq = at")
        whole = whole.withColumn("text", _decoded("text", "foreign"))
        plain = plain.union(whole.select(_ended("text").alias("header"), F.col("header").alias("line")))
    found = plain.distinct().limit(MOST_HEADERS + 1).collect()
    if len(found) > MOST_HEADERS:
        raise ValueError(f"More than {MOST_HEADERS} different headers")
    return [(r.header, r.line) for r in found]


def _cells_by_header(lines: DataFrame, files: DataFrame, headers: list[tuple[str, str]]) -> DataFrame:
    """Rows of all files as text columns, the cells placed by the header of their own file."""
    own = {line: _header_names(text) for text, line in sorted(headers)}
    names = list(dict.fromkeys(n for line in own for n in own[line]))
    places = [(i, line, [own[line].index(n) if n in own[line] else None for n in names]) for i, line in enumerate(own)]
    known = F.broadcast(files.sparkSession.createDataFrame(places, "kind int, header string, places array<int>"))
    # Broadcast, since other joins would move all lines. Places are joined to the headers: a file needs only its kind.
    files = files.join(known, "header").select("file", "at", "foreign", "quoted", "kind")
    held = lines.join(F.broadcast(files), "file")
    plain = held.where("not quoted").select("seq", "at", "foreign", "kind", F.col("value").alias("text"))
    joined = _joined_records(lines, files.where("quoted")).join(F.broadcast(files), "file")
    records = plain.union(joined.select("seq", "at", "foreign", "kind", "text")).where("seq <> at")
    records = records.withColumn("text", _decoded("text", "foreign")).withColumn("text", _ended("text"))
    records = records.join(known.drop("header"), "kind")
    width = max(map(len, own.values()))
    options = {"multiLine": "true", "escape": '"', "maxColumns": str(max(2 * width, 20_480))}
    cells = F.from_csv("text", ", ".join(f"c{i} string" for i in range(width)), options)
    rows = records.where(F.trim("text") != "").select("places", cells.alias("cells"))
    rows = rows.select("places", F.array(*[f"cells.c{i}" for i in range(width)]).alias("cells"))
    return rows.select(*[F.get("cells", F.get("places", F.lit(i))).alias(name) for i, name in enumerate(names)])


def _json_files(lines: DataFrame) -> DataFrame:
    """For each file, its kind: ``lines`` (a record on each), or one document: ``array`` of objects, or ``whole``.

    A file is a document if its first line is no complete value and all brackets outside strings close by its end.
    """
    text = F.trim(F.regexp_replace("value", "[\\s\ufeff]+", " "))
    bare = F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', "")
    depth = F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]"))
    judged = lines.select("file", "seq", text.alias("text"), depth.alias("depth")).where("text <> ''")
    judged = judged.withColumn("record", F.col("text").rlike(r"^[\[{]") & _one_value("text").isNotNull())
    found = judged.groupBy("file").agg(
        F.min(F.struct("seq", "record", "depth", F.left("text", F.lit(1)).alias("sign"))).alias("first"),
        F.sum(F.when(~F.col("record"), F.col("depth"))).alias("left"),
        F.count_if(F.contains("text", F.lit("{"))).alias("objects"),
    )
    document = ~F.col("first.record") & (F.col("first.depth") > 0) & (F.col("left") == 0)
    array = (F.col("first.sign") == "[") & (F.col("objects") > 0)
    return found.select("file", F.when(~document, "lines").when(array, "array").otherwise("whole").alias("kind"))


def _one_value(text: str) -> Column:
    """The only JSON value of a text.

    The parser stops after the first value and would lose what stands behind it. Inside a list and inside an object
    anything more is an error, but for a closing bracket of that kind; so both have to be read.
    """
    values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    alone = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when((F.size(values) == 1) & alone, F.get(values, F.lit(0)))


def _array_elements(pieces: DataFrame) -> DataFrame:
    """Text of every object of documents that are one array; ``pieces`` are cut at every closing brace.

    Whether a piece starts inside a string follows from the quotes before it, and how deep it lies from the brackets
    before it: both are summed up per part of a file, passed on, and then known for every piece, so that a document of
    any length is cut at the elements of its outermost array.
    """
    own, parts = Window.partitionBy("file", "block").orderBy("seq"), Window.partitionBy("file").orderBy("block")
    before, earlier = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (own, parts))

    def with_sum(rows: DataFrame, value: str, name: str) -> DataFrame:
        """The sum of a value over all earlier pieces of the file."""
        sums = rows.groupBy("file", "block").agg(F.sum(value).alias("sum"))
        enters = sums.select("file", "block", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("enters"))
        local = rows.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
        return local.join(enters, ["file", "block"]).withColumn(name, F.col(name) + F.col("enters")).drop("enters")

    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.regexp_count(plain, F.lit('"'))
    rows = with_sum(pieces.select("file", "block", "seq", "value", plain.alias("plain"), quotes.alias("quotes")), "quotes", "earlier_quotes")
    inside = F.col("earlier_quotes") % 2 == 1
    bare = F.regexp_replace(F.when(inside, F.concat(F.lit('"'), "plain")).otherwise(F.col("plain")), '"[^"]*+(?:"|$)', "")
    closing = F.when((F.col("earlier_quotes") + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    depth = F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]")) - closing
    rows = with_sum(rows.select("file", "block", "seq", "value", inside.alias("inside"), depth.alias("depth")), "depth", "earlier")
    first = F.row_number().over(own) == 1
    starts = ~F.col("inside") & ((F.col("earlier") == 1) | ((F.col("earlier") == 0) & first & (F.col("block") == 0)))
    texts = _across_parts(rows.select("file", "block", "seq", "value", starts.alias("starts")), "}")
    texts = texts.where(~F.col("text").rlike(r"^[\s\ufeff,\[]*\]\s*$"))
    return texts.select("file", F.concat(F.regexp_replace("text", r"^[\s\ufeff]*[,\[]", ""), F.lit("}")).alias("text"))


def _json_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of every file as ``record`` (VARIANT), or ``text`` and ``reason`` where there is none."""
    lines = _lines(spark, path)
    files = materialize(_json_files(lines), "json-files")
    kinds = {r.kind for r in files.select("kind").distinct().collect()}
    texts = []
    if "lines" in kinds:
        held = lines if len(kinds) == 1 else lines.join(files.where("kind = 'lines'"), "file")
        texts.append(held.select("file", F.col("value").alias("text")))
    if "whole" in kinds:
        held = lines.join(files.where("kind = 'whole'"), "file")
        order = F.sort_array(F.collect_list(F.struct("seq", "value")))
        whole = held.groupBy("file").agg(F.transform(order, lambda s: s["value"]).alias("held"))
        # A text that is no document after all is judged line by line.
        whole = whole.withColumn("one", _unmarked(F.array_join("held", "\n")))
        parts = F.when(_one_value("one").isNotNull(), F.array("one")).otherwise(F.col("held"))
        texts.append(whole.select("file", F.explode(parts).alias("text")))
    if "array" in kinds:
        pieces = _lines(spark, path, "}").join(files.where("kind = 'array'"), "file")
        texts.append(_array_elements(pieces))
    if not texts:
        return spark.createDataFrame([], "file string, text string, record variant, reason string")
    found = texts[0]
    for more in texts[1:]:
        found = found.union(more)
    found = found.withColumn("text", F.trim(_unmarked(F.col("text")))).where(~F.col("text").rlike(r"^\s*$"))
    found = found.withColumn("value", _one_value("text"))
    values = F.coalesce(F.try_variant_get("value", "$", "array<variant>"), F.array("value"))
    found = found.withColumn("record", F.explode(values))
    reason = F.when(F.col("value").isNull(), "not JSON").when(~F.schema_of_variant("record").startswith("OBJECT"), "no object")
    text = F.when(F.col("value").isNull(), F.col("text")).otherwise(F.to_json("record"))
    return found.select("file", text.alias("text"), "record", reason.alias("reason"))


def _unmarked(text: Column) -> Column:
    """Text without a byte order mark."""
    return F.regexp_replace(text, "^\ufeff", "")


def rejected_json(spark: SparkSession, path: str) -> DataFrame:
    """What ``read_json`` leaves out: ``file``, ``text`` and ``reason``; lists are judged element by element."""
    return _json_records(spark, path).where("reason is not null").select("file", "text", "reason")


def _exact(kind: T.DataType) -> T.DataType:
    """Types for what was found: fractions are double if all fit a double, what was mixed or never seen is text."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _exact(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_exact(kind.elementType))
    if isinstance(kind, (T.NullType, T.VariantType)):
        return T.StringType()
    if isinstance(kind, T.DecimalType) and 0 < kind.scale and kind.precision <= 15:
        return T.DoubleType()
    return kind


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines, arrays of objects, or objects of equally long lists; a folder may hold files of all kinds.

    Lines are judged one by one: a broken one is left out and found by ``rejected_json``. An array of objects is split
    at its elements, also inside one large file. Types hold all values of a column exactly: whole numbers beside
    fractions are decimals if a double cannot hold them, and mixed types are text.

    If every column is a list, and in every record all lists have one length, the records are columns of values and
    their positions become rows, however many records there are.
    """
    records = _json_records(spark, path).where("reason is null").select("record")
    if schema is None:
        shape = records.agg(F.schema_of_variant_agg("record")).first()[0]
        if not shape or not shape.startswith("OBJECT<"):
            return spark.createDataFrame([], T.StructType([]))
        wanted = _exact(variant_type(shape))
    else:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    values = [F.try_variant_get("record", f"$[{_quoted(f.name)}]", type_ddl(f.dataType)).alias(f.name) for f in wanted.fields]
    df = records.select(*values)
    if df.columns and all(isinstance(f.dataType, T.ArrayType) for f in df.schema.fields):
        sizes = [F.size(col(c)) for c in df.columns]
        even = F.coalesce(F.least(*sizes, sizes[0]) == F.greatest(*sizes, sizes[0]), F.lit(False))
        if not df.agg(F.count_if(~even)).first()[0]:
            return df.select(F.inline(F.arrays_zip(*[col(c) for c in df.columns])))
    return df


def _quoted(name: str) -> str:
    """A field name in a path."""
    return f"'{name}'" if "'" not in name else f'"{name}"'


def variant_type(shape: str) -> T.DataType:
    """The type that ``schema_of_variant`` names."""
    # Names are quoted where they could be taken for types.
    parts = re.split(r"(`(?:[^`]|``)*`)", shape)
    return T.DataType.fromDDL("".join(p if i % 2 else p.replace("OBJECT<", "STRUCT<") for i, p in enumerate(parts)))


def type_ddl(kind: T.DataType) -> str:
    """A type in SQL, with all names quoted."""
    if isinstance(kind, T.StructType):
        fields = ", ".join(f"`{f.name.replace('`', '``')}`: {type_ddl(f.dataType)}" for f in kind.fields)
        return f"struct<{fields}>"
    if isinstance(kind, T.ArrayType):
        return f"array<{type_ddl(kind.elementType)}>"
    return kind.simpleString()


READERS = {"csv": read_csv, "json": read_json}


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read by format or extension, with the options of that reader; empty files and unknown formats are refused."""
    kind = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind not in READERS:
        hint = " (spreadsheets are not read; export them as CSV)" if kind in UNSUPPORTED else ""
        raise ValueError(f"Unsupported file format: {kind}{hint}")
    df = READERS[kind](spark, path, **options)
    if not df.columns:
        raise ValueError("No columns found in file")
    if df.isEmpty():
        raise ValueError("File appears to be empty")
    return df


def preview(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*[col(c) for c in order_by]).limit(n)
