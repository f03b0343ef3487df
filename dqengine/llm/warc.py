"""WARC archives: writing captures, reading records, and joining them into transactions.

A capture is three records: the response (or a revisit, if an equal payload was captured before), the request, and
metadata. Request and metadata name the response's record in ``WARC-Concurrent-To``; in archives of others any record
may name any other. ``transactions`` joins the records that these identifiers connect and gives one nested row per
capture.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqengine.llm.common import one_each, ship, small_batches, whole_text
from dqengine.llm.links import components
from dqengine.session import materialize

GZIP = b"\x1f\x8b\x08"
#: A file is closed when it has so many bytes.
FILE_BYTES = 64 << 20
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "warc-capture")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORD = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
    "headers map<string,string>, http_status string, http_headers map<string,string>, fields map<string,string>, "
    "payload_bytes long, payload_digest string, payload binary"
)


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, '|'.join(map(str, parts)))}>"


def _one_line(value: str) -> str:
    """A header value: line breaks would end the header."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _record(kind: str, identifier: str, headers: dict[str, str], block: bytes, content: str) -> bytes:
    """One record as a gzip member."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": identifier, "WARC-Date": DATE} | headers
    lines |= {"Content-Type": content, "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_one_line(v)}\r\n" for k, v in lines.items()) + "\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def capture_records(page_id, url: str | None, payload: bytes, copy: int, first_page, revisit: bool) -> list[bytes]:
    """The records of one capture. ``copy`` tells repeated rows of one page apart."""
    own = digest(payload)
    identifier = record_id(page_id, own, copy)
    target = {"WARC-Target-URI": url} if url else {}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = target | {"WARC-Payload-Digest": f"sha1:{own}"}
    if revisit:
        headers |= {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(first_page, own, 0)}
    kind, body = ("revisit", http) if revisit else ("response", http + payload)
    about = target | {"WARC-Concurrent-To": identifier}
    fields = f"page-id: {page_id}\r\n".encode() if page_id is not None else b""
    request = f"GET {_one_line(url or '/')} HTTP/1.1\r\n\r\n".encode()
    return [
        _record(kind, identifier, headers, body, "application/http;msgtype=response"),
        _record("request", record_id(identifier, "request"), about, request, "application/http;msgtype=request"),
        _record("metadata", record_id(identifier, "metadata"), about, fields, "application/warc-fields"),
    ]


def write(
    pages: DataFrame, directory: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    least_bytes: int = 0,
) -> DataFrame:
    """Write one capture per row into ``.warc.gz`` files below ``directory``; returns the list of files (``file``).

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the smallest id is the response and the
    others revisit it; rows that repeat this smallest id with the same payload are responses too. Smaller payloads are
    all responses. Null HTML is an empty payload; a null id comes after all others. A repeated task writes the same
    files again, under a draft name until they are complete. Other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    payload = whole_text(html_column)
    rows = pages.select(
        F.col(f"`{id_column}`").cast("long").alias("page_id"),
        F.col(f"`{url_column}`").cast("string").alias("url"),
        payload.alias("html"),
        F.sha2(payload, 256).alias("same"),
    )
    slim = rows.select("page_id", "same")
    known = F.struct(F.col("page_id").isNull(), "page_id")
    firsts = slim.groupBy("same").agg(F.min(known)["page_id"].alias("first_page"))
    marks = materialize(
        slim.distinct().join(firsts, "same").filter(~F.col("page_id").eqNullSafe(F.col("first_page"))), "revisits"
    )
    marks = marks.select(F.col("page_id").alias("p"), F.col("same").alias("s"), "first_page", F.lit(True).alias("later"))
    long_enough = F.octet_length("html") >= least_bytes
    ready = (
        rows.join(marks, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("same") == F.col("s")), "left")
        .withColumn("revisit", F.coalesce(F.col("later") & long_enough, F.lit(False)))
        .select("page_id", "same", "url", "html", "first_page", "revisit")
        .repartition("page_id", "same")
        .sortWithinPartitions("page_id", "same", "url")
    )

    def store(batches):
        files, folder = fs.FileSystem.from_uri(directory)
        part = TaskContext.get().partitionId()
        out, names, size, before, copy = None, [], 0, None, 0

        def finish():
            out.close()
            files.move(f"{folder}/{names[-1]}.{attempt}.draft", f"{folder}/{names[-1]}")

        attempt = TaskContext.get().taskAttemptId()
        for batch in small_batches(batches, "html"):
            for row in batch.to_pylist():
                key = row["page_id"], row["same"]
                copy = copy + 1 if key == before else 0
                before = key
                if out is None:
                    names.append(f"part-{part:06d}-{len(names):06d}.warc.gz")
                    out, size = files.open_output_stream(f"{folder}/{names[-1]}.{attempt}.draft", compression=None), 0
                for data in capture_records(
                    row["page_id"], row["url"], row["html"].encode(), copy, row["first_page"], row["revisit"]
                ):
                    out.write(data)
                    size += len(data)
                if size >= FILE_BYTES:
                    finish()
                    out = None
        if out is not None:
            finish()
        yield pa.record_batch({"file": pa.array([f"{directory}/{n}" for n in names], pa.string())})

    files, folder = fs.FileSystem.from_uri(directory)
    files.create_dir(folder, recursive=True)
    return materialize(ready.mapInArrow(store, "file string"), "warc-files")


class Damaged(bytes):
    """What could be read of a record before its archive member turned out to be damaged."""


def unpacked(stream, piece: int = 1 << 20) -> Iterator[bytes | None]:
    """The bytes of a file in pieces: those of its gzip members one after the other, or as they are if it has none.

    What stands between members (padding, line breaks) is skipped. Where a member is damaged, None is given, and
    reading goes on with the next one.
    """
    data = stream.read(piece)
    if not data.startswith(GZIP):
        while data:
            yield data
            data = stream.read(piece)
        return
    unpacker, fresh = None, True
    while True:
        if unpacker is None:
            while (at := data.find(GZIP)) < 0:
                more = stream.read(piece)
                if not more:
                    return
                data = data[-len(GZIP) + 1 :] + more
            data, unpacker, fresh = data[at:], zlib.decompressobj(31), True
        if not data and not (data := stream.read(piece)):
            yield unpacker.flush()
            return
        try:
            out = unpacker.decompress(data, 16 * piece)
        except zlib.error:
            yield None
            data, unpacker = data[1:] if fresh else data, None
            continue
        yield out
        data, fresh = unpacker.unconsumed_tail, False
        if unpacker.eof:
            data, unpacker = unpacker.unused_data, None


def _length(headers: dict[str, str]) -> int | None:
    value = headers.get("content-length", "").partition(",")[0]
    return int(value) if value.isascii() and value.isdigit() else None


def split_records(stream) -> Iterator[bytes]:
    """The records of a file, one at a time: each may be a gzip member, several may share one, or none is packed.

    A record ends by its Content-Length; without one it goes on to the next record. What is between records is skipped,
    and the last one of a file that was cut off is given as far as it goes. A record in a damaged member is given as
    ``Damaged``, as far as it was read.
    """
    pieces, buffer, end_of_file, damaged = unpacked(stream), bytearray(), object(), False

    def more() -> bool:
        """Read on; not past the place of a damage, before it was told."""
        nonlocal damaged
        piece = end_of_file if damaged else next(pieces, end_of_file)
        damaged = damaged or piece is None
        if damaged or piece is end_of_file:
            return False
        buffer.extend(piece)
        return True

    def find(mark: bytes, start: int) -> int:
        """Where the mark is after ``start``, reading on as far as needed; -1 if it does not come."""
        while (at := buffer.find(mark, start)) < 0:
            start = max(start, len(buffer) - len(mark) + 1)
            if not more():
                return -1
        return at

    while True:
        while not buffer.startswith(b"WARC/"):
            at = buffer.find(b"\nWARC/")
            del buffer[: at + 1 if at >= 0 else max(0, len(buffer) - 5)]
            if at < 0 and not more():
                if not damaged:
                    return
                damaged = False
                buffer.clear()
                yield Damaged()
        head = find(b"\r\n\r\n", 0)
        length = _length(_head(bytes(buffer[:head]))[1]) if head >= 0 else None
        if length is None:
            at = find(b"\r\n\r\nWARC/", head) if head >= 0 else -1
            end = at if at >= 0 else len(buffer)
        else:
            end = head + 4 + length
            while len(buffer) < end and more():
                pass
        if damaged and (length is None or len(buffer) < end):
            damaged = False
            yield Damaged(buffer)
            buffer.clear()
        else:
            yield bytes(buffer[:end])
            del buffer[:end]


def _pairs(head: bytes) -> tuple[str, list[tuple[str, str]]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = (line.split(":", 1) for line in lines if ":" in line)
    return first, [(k.strip().lower(), v.strip()) for k, v in pairs]


def _head(data: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, headers with lower-case names (repeated ones with all values, by commas), and the rest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, pairs = _pairs(head)
    headers: dict[str, str] = {}
    for name, value in pairs:
        headers[name] = f"{headers[name]}, {value}" if name in headers else value
    return first, headers, rest


def parse(data: bytes, keep_payload: bool) -> dict | None:
    """One record as a row; None for anything else than a WARC record.

    Of a damaged record the type is ``damaged``; it has the headers that could be read, and no content.
    """
    if isinstance(data, Damaged) and (not data.startswith(b"WARC/") or b"\r\n\r\n" not in data):
        return {"type": "damaged", "concurrent_to": [], "headers": []}
    if not data.startswith(b"WARC/"):
        return None
    _, headers, rest = _head(data)
    length = _length(headers)
    block = rest if length is None else rest[:length]
    kind = "damaged" if isinstance(data, Damaged) else headers.get("warc-type")
    row = {
        "record_id": headers.get("warc-record-id"),
        "type": kind,
        "concurrent_to": [v.strip() for v in headers.get("warc-concurrent-to", "").split(",") if v.strip()],
        "refers_to": headers.get("warc-refers-to"),
        "target_uri": headers.get("warc-target-uri"),
        "date": headers.get("warc-date"),
        "headers": list(headers.items()),
    }
    if kind in ("response", "revisit"):
        status, http, payload = _head(block)
        row |= {"http_status": status, "http_headers": list(http.items())}
        if kind == "response":
            row |= {"payload_bytes": len(payload), "payload_digest": digest(payload)}
            row["payload"] = payload if keep_payload else None
        else:  # what was not stored again is described by the headers
            row["payload_bytes"] = _length(http)
            row["payload_digest"] = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    elif kind == "metadata":
        row["fields"] = list(_head(b"\r\n" + block)[1].items())
    return row


def read(files: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records of WARC files, packed or not, as rows; see ``RECORD``. ``files`` has the column ``file``.

    The digest of a response is computed from the payload that was read, that of a revisit is its header's. Records
    in damaged members have the type ``damaged`` and belong to no capture.
    """
    ship(files.sparkSession)
    kinds = {"concurrent_to": "a", "headers": "m", "http_headers": "m", "fields": "m", "payload_bytes": "l", "payload": "b"}
    names = [part.split()[0] for part in RECORD.split(", ")]
    types = {"a": pa.list_(pa.string()), "m": pa.map_(pa.string(), pa.string()), "l": pa.int64(), "b": pa.binary()}
    schema = pa.schema([(n, types.get(kinds.get(n), pa.string())) for n in names])

    def scan(batches):
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                files, path = fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for record in split_records(stream):
                        row = parse(record, keep_payload)
                        if row:
                            rows.append(row)
                            size += 500 + len(row.get("payload") or b"")
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return one_each(files.select("file")).mapInArrow(scan, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its ``requests`` and ``metadata``.

    Records belong together where ``concurrent_to``, of either of two records and over others in between, connects
    them; if several captures are connected, each has the requests and metadata of all. Both are lists, empty if none
    was read; there is one of each in archives of ``write``. Records that belong to no capture are left out.
    """
    is_capture = F.col("type").isin("response", "revisit")
    captures = records.filter(is_capture).drop("concurrent_to", "fields")
    about = records.filter(F.col("type").isin("request", "metadata"))
    named = materialize(
        records.filter("record_id is not null").select("record_id", is_capture.alias("capture"), "concurrent_to"),
        "warc-names",
    )
    edges = named.select(
        "capture", "record_id", F.size("concurrent_to").alias("n"), F.explode("concurrent_to").alias("other")
    )
    ids = named.filter("capture").select(F.col("record_id").alias("other"))
    # Every record names one capture and no capture names a record: then no chains need to be followed.
    plain = edges.filter("capture or n > 1").isEmpty() and edges.join(ids, "other", "left_anti").isEmpty()
    if plain:
        about = about.withColumn("root", F.get("concurrent_to", F.lit(0)))
        captures = captures.withColumn("root", F.col("record_id"))
    else:
        roots = materialize(components(edges.select(F.col("record_id").alias("a"), F.col("other").alias("b"))), "roots")
        roots = roots.withColumnRenamed("node", "record_id")
        about = about.join(roots, "record_id")
        captures = captures.join(roots, "record_id", "left")

    def of(kind: str, *columns: str):
        return F.collect_list(F.when(F.col("type") == kind, F.struct(*columns)))

    grouped = (
        about.filter("root is not null")
        .groupBy("root")
        .agg(
            of("request", "record_id", "target_uri", "headers").alias("requests"),
            of("metadata", "record_id", "fields").alias("metadata"),
        )
    )
    joined = captures.join(grouped, "root", "left").drop("root")
    return joined.withColumns({c: F.coalesce(c, F.array()) for c in ("requests", "metadata")})


def captures(records: DataFrame) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` (a page) of each capture."""
    slim = records.select(
        "record_id", "type", "concurrent_to", "refers_to", "fields", "payload_bytes", "payload_digest",
        F.lit(None).cast("string").alias("target_uri"), F.lit(None).cast("map<string,string>").alias("headers"),
    )
    found = transactions(materialize(slim, "warc-records")).select(
        "record_id",
        F.col("metadata")[0]["fields"]["page-id"].cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        "refers_to",
    )
    found = materialize(found, "captures")
    originals = found.filter("record_type = 'response'").select(
        F.col("record_id").alias("original"), F.col("page_id").alias("original_page")
    )
    return found.join(originals, F.col("refers_to") == F.col("original"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("original_page").alias("refers_to")
    )
