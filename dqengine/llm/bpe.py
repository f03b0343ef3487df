"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Every chunk is pre-tokenised on its own, long texts' chunks in parallel
tasks. Where the pre-tokens of one chunk and of the next end at the same place inside the overlap, the two scans
have fallen into step: from there on they agree, and the chunks are stitched at that place. The stitched pieces are
encoded one by one. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.llm.common import Bounded, ship, small_batches, stand_ins, whole_text

CHUNK, OVERLAP = 65_536, 1_024
#: A pre-token that ends this close to the end of its chunk may end elsewhere in the whole text.
MARGIN = 3
#: Pieces a Python worker remembers.
REMEMBERED = 300_000


class Vocabulary:
    """Ranks of a tiktoken file and the encoding of single pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.matches = regex.compile(pattern).findall
        # Two bytes that make one token show whether two characters stand in one pre-token.
        probes = {bytes([b]): b for b in range(256)}
        for first in b"a1":
            probes.update({bytes([first, b]): len(probes) + b for b in range(128, 256)})
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=probes, special_tokens={}).encode_ordinary
        self.shadow = stand_ins(lambda c: any(len(probe(x + c)) == len(c.encode()) for x in "a1"))
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ids = Bounded(lambda piece: np.array(encode(piece), "<u4").tobytes(), REMEMBERED)
        self.token = np.empty(max(ranks.values()) + 1, object)
        for token, rank in ranks.items():
            self.token[rank] = token

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text, as the library takes them."""
        shadow = self.shadow(text)
        found = self.matches(shadow)
        return found if shadow is text else pieces_of(text, np.cumsum(list(map(len, found))).tolist())

    def encode(self, pieces: list[str]) -> bytes:
        """Ids of the pieces, in order, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.ids.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.token[np.frombuffer(ids, "<u4")].tolist())


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def ends(split, text: str, start: int = 0) -> list[int]:
    """Where the pre-tokens of a text end, counted from ``start``."""
    return (np.cumsum(list(map(len, split(text))), dtype=np.int64) + start).tolist() if text else []


def stitch(split, text: str, scans: list[tuple[int, int, list[int]]]) -> list[int]:
    """Ends of the whole text's pre-tokens from the scans (start, end, pre-token ends) of its chunks.

    Where two neighbouring scans do not fall into step inside their overlap, as in one long run of letters, the
    earlier scan goes on from its last certain end through the next chunk.
    """
    done: list[int] = []
    _, stop, current = scans[0]
    for start, next_stop, following in scans[1:]:
        certain = [e for e in current[:-1] if e <= stop - MARGIN]
        steps = {start, *following}
        meet = next((e for e in certain if e >= start and e in steps), None)
        if meet is not None:
            done += [e for e in certain if e <= meet]
            current = [e for e in following if e > meet]
        else:
            done += certain
            last = done[-1] if done else 0
            current = ends(split, text[last:next_stop], last)
        stop = next_stop
    return done + current


def pieces_of(text: str, cuts: list[int]) -> list[str]:
    return [text[a:b] for a, b in zip([0, *cuts], cuts)]


def encode(
    docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """``doc_id`` and ``ids`` (binary, little-endian unsigned 32-bit integers) of every whole text.

    A null text is empty and has no ids. Rows with the same id and text come out as often as they went in; a null id
    is kept. Other columns are not read. The vocabulary file is read on every executor from ``path``.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), whole_text(text_column).alias("text"))
    size = F.char_length("text")
    id_type = rows.schema["doc_id"].dataType
    encoded = T.StructType([T.StructField("doc_id", id_type), T.StructField("ids", T.BinaryType())])

    def single(batches):
        known = vocabulary(path, pattern)
        for batch in small_batches(batches, "text"):
            ids = [known.encode(known.split(text)) for text in batch.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary())})

    short = rows.filter(size <= chunk).mapInArrow(single, encoded)

    key = ["doc_id", "digest", "size"]
    chunks = (
        rows.filter(size > chunk)
        .withColumns({"digest": F.sha2("text", 256), "size": size})
        .withColumn("number", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / chunk).cast("int") - 1)))
        .withColumn("text", F.substring("text", F.col("number") * chunk + 1, F.lit(chunk + overlap)))
        .repartition(*key, "number")
    )
    scanned = T.StructType([*chunks.schema.fields, T.StructField("cuts", T.ArrayType(T.LongType()))])

    def scan(batches):
        known = vocabulary(path, pattern)
        for batch in small_batches(batches, "text"):
            cuts = [
                ends(known.split, text, number * chunk)
                for text, number in zip(batch.column("text").to_pylist(), batch.column("number").to_pylist())
            ]
            yield batch.append_column("cuts", pa.array(cuts, pa.list_(pa.int64())))

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        known = vocabulary(path, pattern)
        copies = int((group["number"] == 0).sum())
        parts = group.drop_duplicates("number").sort_values("number")
        text = "".join(part[:chunk] for part in parts["text"])
        scans = [
            (number * chunk, number * chunk + len(part), list(cuts))
            for number, part, cuts in zip(parts["number"], parts["text"], parts["cuts"])
        ]
        ids = known.encode(pieces_of(text, stitch(known.split, text, scans)))
        return pd.DataFrame({"doc_id": [group["doc_id"].iloc[0]] * copies, "ids": [ids] * copies})

    long = chunks.mapInArrow(scan, scanned).groupBy(*key).applyInPandas(joined, encoded)
    return short.unionByName(long)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The table with ``decoded``: the raw bytes of ``ids``. Null ids give null."""
    ship(encoded.sparkSession)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def restore(batches):
        known = vocabulary(path, pattern)
        for batch in small_batches(batches, "ids"):
            out = [None if ids is None else known.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield batch.append_column("decoded", pa.array(out, pa.binary()))

    return encoded.mapInArrow(restore, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document the number of ids and the SHA-256 of the ids and of the decoded bytes."""
    return decode(encode(docs, path, pattern), path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
