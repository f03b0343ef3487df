"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments, and every segment has a table of its own, from the segment's value to the
fingerprints that have it. Of two fingerprints that differ in a few bits, some segment differs in no more than its
share of them: so a fingerprint looks up every value in a small Hamming ball around each of its segments, and the
complete distance of what it finds is verified.

Fingerprints of near copies share whole segments, and a value that very many of them have would list all their pairs.
Such values are looked up no further; the fingerprints that meet them are linked through complete keys instead: each
enters under every fingerprint of half the distance around it. Two within the distance share such a key, and no more
than a ball's number of fingerprints can, so no group is too large, and all members of a key are linked to its
smallest, which keeps every connection.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.llm.common import free_names, ship, small_batches, whole_text
from dqengine.llm.links import components
from dqengine.session import materialize

SEED = 42
SEGMENTS = 2
#: A segment's value that more fingerprints have is not looked up.
MOST_ALIKE = 64


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of the ``words``-word shingles of a text, A-Z in lower case, as a signed 64-bit integer.

    Fewer words give one shingle of all of them; no word gives zero.
    """
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    stops = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(stops[:-1] + 1).tolist()]
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    stops = stops.tolist()[min(words, len(parts)) - 1 :]
    counts, step = np.zeros(64, np.int64), 1 << 16
    for first in range(0, n, step):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[first : min(first + step, n)], stops[first:])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``digest`` (hash of the text) and ``bits`` (the fingerprint as a long) of every document.

    A null text is empty. Null ids and repeated rows are kept; other columns are not read.
    """
    ship(docs.sparkSession)
    text = whole_text(text_column)
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("bits", T.LongType())])

    def compute(batches):
        for batch in small_batches(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            bits = pa.array([fingerprint(t, words) for t in texts], pa.int64())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "bits": bits})

    return rows.mapInArrow(compute, schema)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def balls(radius: int) -> list[int]:
    """Bit masks of a ball: up to ``radius`` flipped bits; first none."""
    return [_signed(sum(1 << b for b in c)) for k in range(radius + 1) for c in combinations(range(64), k)]


def _linked(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _near(found: DataFrame, most_bits: int) -> DataFrame:
    return found.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits)


def key_links(distinct: DataFrame, most_bits: int) -> DataFrame:
    """Links through complete keys; for an odd ``most_bits`` one side's balls are larger by one."""
    near, far = balls(most_bits // 2), balls((most_bits + 1) // 2)
    at = lambda masks: F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("bits").bitwiseXOR(m)))
    probes = distinct.select("bits", at(far).alias("key"))
    if near == far:
        first = F.min("bits").over(Window.partitionBy("key"))
        found = probes.select("bits", first.alias("a")).filter("a < bits").select("a", F.col("bits").alias("b"))
    else:
        table = distinct.select(F.col("bits").alias("other"), at(near).alias("key"))
        found = probes.join(table, "key").filter("bits <> other").select(*_linked("bits", "other"))
    return _near(found.distinct(), most_bits)


def segment_keys(segments: int, flipped: int) -> Column:
    """Of every segment of ``bits``, numbered above its value, the value itself and, if asked, all with one bit set more.

    Of two values that differ in one bit, one has it set: the other one looks for it, so each pair is found once.
    """
    width = 64 // segments
    keys = []

    def one_more(value: Column, own: Column, wide: int) -> Column:
        unset = F.filter(F.array(*[F.lit(1 << b) for b in range(wide)]), lambda m: value.bitwiseAND(m) == 0)
        return F.transform(unset, lambda m: own.bitwiseOR(m))

    for s in range(segments):
        wide = 64 - width * s if s == segments - 1 else width
        value = F.shiftrightunsigned("bits", width * s).bitwiseAND(F.lit((1 << wide) - 1))
        own = value.bitwiseOR(F.lit(s << 60)) if wide <= 56 else value
        keys.append(F.array(own))
        if flipped:
            keys.append(one_more(value, own, wide))
    return F.explode(F.flatten(F.array(*keys)))


def links(distinct: DataFrame, most_bits: int, segments: int = SEGMENTS) -> DataFrame:
    """``a`` < ``b``: links between different fingerprints (column ``bits``), enough to connect all within ``most_bits``.

    With one segment all go through complete keys, whose balls are meant for distances up to 3. Else a segment may
    differ in ``most_bits // segments`` bits, of which one is supported.
    """
    if not 0 <= most_bits <= 3 or segments > 1 and most_bits // segments > 1:
        raise ValueError("distances go from 0 to 3, and a segment may differ in one bit")
    if segments == 1:
        return key_links(distinct, most_bits)
    table = distinct.select(F.col("bits").alias("other"), segment_keys(segments, 0).alias("key"))
    probes = distinct.select("bits", segment_keys(segments, most_bits // segments).alias("key"))
    common = table.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_ALIKE).select("key")
    common = materialize(common, "common-segments")
    rare = probes.join(common, "key", "left_anti").join(table, "key").filter("bits <> other")
    found = _near(rare.select(*_linked("bits", "other")), most_bits).distinct()
    if common.isEmpty():
        return found
    met = materialize(probes.join(common, "key", "left_semi").select("bits").distinct(), "alike")
    return found.union(key_links(met, most_bits)).distinct()


def near_duplicates(
    docs: DataFrame, words: int = 3, most_bits: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id``, ``digest``, ``bits``, ``fingerprint`` (16 hex digits), ``component_id`` and ``group`` of every document.

    ``component_id`` is the smallest id among all documents that links reach, ``group`` the smallest fingerprint.
    Documents without a word have fingerprint zero and are linked like any other. Null ids never become a component's
    id, unless it has no other.
    """
    prints = materialize(fingerprints(docs, words, id_column, text_column), "fingerprints")
    distinct = prints.groupBy("bits").agg(F.min("doc_id").alias("first"))
    distinct = materialize(distinct, "distinct-fingerprints")
    found = materialize(links(distinct.select("bits"), most_bits), "links")
    roots = components(found)
    grouped = distinct.join(roots.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "first", F.coalesce("root", "bits").alias("group")
    )
    smallest = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    classes = materialize(grouped.join(smallest, "group").select("bits", "group", "component_id"), "classes")
    return prints.join(classes, "bits").select(
        "doc_id", "digest", "bits", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "group"
    )


def drop_near_duplicates(
    docs: DataFrame, words: int = 3, most_bits: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One document of each component stays, that with the smallest id, in the columns of ``docs``.

    Among rows of one id the smallest text hash decides; of those with equal texts, the first by all other columns, as
    far as these can be sorted.
    """
    classes = near_duplicates(docs, words, most_bits, id_column, text_column)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("best")
    keep = materialize(
        classes.groupBy("group").agg(best).select("best.doc_id", "best.digest").distinct(), "kept"
    )
    digest, wanted_id, wanted_digest, number = free_names(docs, "digest", "wanted_id", "wanted_digest", "number")
    keep = keep.withColumnsRenamed({"doc_id": wanted_id, "digest": wanted_digest})
    rows = docs.withColumn(digest, F.xxhash64(whole_text(text_column)))
    same = F.col(f"`{id_column}`").eqNullSafe(F.col(wanted_id)) & (F.col(digest) == F.col(wanted_digest))
    columns = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    alike = Window.partitionBy(f"`{id_column}`", digest).orderBy(*(columns or [F.lit(0)]))
    kept = rows.join(keep, same, "left_semi").withColumn(number, F.row_number().over(alike))
    return kept.filter(F.col(number) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
