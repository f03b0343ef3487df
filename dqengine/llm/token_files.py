"""Token ids in binary files, packed by Simple-8b.

A 64-bit word holds a selector in its upper 4 bits and, in the other 60, as many ids of equal width as fit. Widths
follow from how many ids share the 60 bits. An id of more than 60 bits does not fit any word: its word is an escape
that names a place in the block's list of raw ids. Ids go into blocks of fixed length; every file ends with the
offset of each block and the number of ids of each document, so that a reader can start at any block, and decode a
block without a loop over its ids.

A file: ``S8B1``, blocks, block offsets, document ids, document null flags, document lengths, and a trailer with the
place and the sizes of these lists. A block: three unsigned 32-bit numbers (ids, words, raw ids), words, raw ids. All
numbers are little-endian.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from dqengine.llm.common import Bounded, byte_alphabet, one_each, ship, small_batches, whole_text
from dqengine.session import materialize

MAGIC = b"S8B1"
TRAILER = struct.Struct("<QQQQ4s")  # place of the lists, blocks, documents, ids, magic
BLOCK = 16_384
#: A file is closed when it has so many ids.
FILE_IDS = 16 << 20
#: Selectors 1 to 14: ids of so many bits, so many to a word. Selector 0 is the escape.
WIDTHS = sorted({60 // n for n in range(1, 61)} - {0})
WIDTHS = [w for w in WIDTHS if 60 // w > 60 // (w + 1) or w == 60][-14:]
COUNTS = [60 // w for w in WIDTHS]
REMEMBERED = 400_000


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Number of bits of unsigned 64-bit integers; a double alone is exact up to 53 bits."""
    small = np.frexp(ids.astype(np.float64))[1]
    return np.where(ids >> np.uint64(53) != 0, np.frexp((ids >> np.uint64(11)).astype(np.float64))[1] + 11, small)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and raw ids of one block of unsigned 64-bit ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    # For every place the densest word that can start there: the widest of the next ids must fit its width.
    best = np.zeros(n, np.int8)
    widest, reach = bit_lengths(ids), 1
    for selector in range(len(WIDTHS), 0, -1):
        width, count = WIDTHS[selector - 1], COUNTS[selector - 1]
        if count > n:
            break
        # Windows of ``reach`` ids, at both ends of a window of ``count``, cover it.
        widest = np.maximum(widest[: n - count + 1], widest[count - reach : n - reach + 1])
        reach = count
        best[: n - count + 1][widest <= width] = selector
    counts = np.array([1, *COUNTS])[best]
    following = (np.arange(n) + counts).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = following[at]
    starts = np.array(starts)
    chosen = best[starts].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    raw = ids[starts[chosen == 0]]
    words[chosen == 0] = np.arange(len(raw), dtype=np.uint64)
    for selector in np.unique(chosen[chosen > 0]):
        width, count = WIDTHS[selector - 1], COUNTS[selector - 1]
        which = chosen == selector
        values = ids[starts[which][:, None] + np.arange(count)]
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
        words[which] |= np.bitwise_or.reduce(values << shifts, axis=1)
    return words, raw


def unpack(words: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The ids of one block."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([1, *COUNTS])[selectors]
    starts = np.cumsum(counts) - counts
    ids = np.empty(int(counts.sum()), np.uint64)
    payload = words & np.uint64((1 << 60) - 1)
    for selector in np.unique(selectors):
        which = selectors == selector
        if selector == 0:
            ids[starts[which]] = raw[payload[which].astype(np.int64)]
            continue
        width, count = WIDTHS[selector - 1], COUNTS[selector - 1]
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
        mask = np.uint64((1 << width) - 1)
        ids[starts[which][:, None] + np.arange(count)] = (payload[which][:, None] >> shifts) & mask
    return ids


class Writer:
    """Writes documents one after the other; the file appears under its name only when it is complete."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.files, self.path = files, path
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        self.draft = f"{path}.{attempt}.draft"
        self.out = files.open_output_stream(self.draft)
        self.out.write(MAGIC)
        self.at, self.offsets, self.documents, self.lengths = len(MAGIC), [], [], []
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0

    def add(self, document: int | None, ids: np.ndarray) -> None:
        self.documents.append(document)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            ready = np.concatenate(self.waiting).astype(np.uint64)
            whole = len(ready) // BLOCK * BLOCK
            for start in range(0, whole, BLOCK):
                self._block(ready[start : start + BLOCK])
            self.waiting, self.n_waiting = [ready[whole:]], len(ready) - whole

    def _block(self, ids: np.ndarray) -> None:
        words, raw = pack(ids)
        data = struct.pack("<III", len(ids), len(words), len(raw)) + words.astype("<u8").tobytes() + raw.astype("<u8").tobytes()
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting).astype(np.uint64))
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.documents], "<i8").tobytes())
        self.out.write(np.array([d is None for d in self.documents], np.uint8).tobytes())
        self.out.write(np.array(self.lengths, "<u8").tobytes())
        self.out.write(TRAILER.pack(self.at, len(self.offsets), len(self.documents), self.n_ids, MAGIC))
        self.out.close()
        self.files.move(self.draft, self.path)


class Reader:
    """Reads a file of ``Writer``; blocks are read when they are needed."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        place, blocks, documents, self.n_ids, magic = TRAILER.unpack(
            self.file.read_at(TRAILER.size, size - TRAILER.size)
        )
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        lists = self.file.read_at(size - TRAILER.size - place, place)
        self.offsets = np.frombuffer(lists, "<u8", blocks)
        self.documents = np.frombuffer(lists, "<i8", documents, 8 * blocks)
        self.null = np.frombuffer(lists, np.uint8, documents, 8 * (blocks + documents))
        self.lengths = np.frombuffer(lists, "<u8", documents, 8 * blocks + 9 * documents)

    def block(self, number: int) -> np.ndarray:
        start = int(self.offsets[number])
        n_ids, n_words, n_raw = struct.unpack("<III", self.file.read_at(12, start))
        data = np.frombuffer(self.file.read_at(8 * (n_words + n_raw), start + 12), "<u8")
        return unpack(data[:n_words], data[n_words:])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, from the blocks that hold them."""
        if start >= stop:
            return np.zeros(0, np.uint64)
        first = start // BLOCK
        joined = np.concatenate([self.block(b) for b in range(first, (stop - 1) // BLOCK + 1)])
        return joined[start - first * BLOCK : stop - first * BLOCK]

    def texts(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """Every document in order with its ids, in parts; a block is decoded once and then let go."""
        number, block, at = -1, np.zeros(0, np.uint64), 0
        for document, null, length in zip(self.documents.tolist(), self.null.tolist(), self.lengths.tolist()):
            parts = []
            while length:
                if at == len(block):
                    number, at = number + 1, 0
                    block = self.block(number)
                part = block[at : at + length]
                parts.append(part)
                at += len(part)
                length -= len(part)
            yield (None if null else document), parts


class WordEncoder:
    """Ids of a tokenizers file whose normaliser and split leave no white space inside a pre-token.

    Then the ids of a text are those of its parts between white space, and of their pre-tokens, one after the other.
    Parts and pre-tokens that were seen before need no encoding. The normaliser must be NFC and lower case; the library
    encodes the pre-tokens, and whole parts where its own reading of them matters.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("the normaliser must be NFC, white space and lower case")
        if split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("the pre-tokens must be the matches of one pattern")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.tokenize = self.library.model.tokenize
        self.letters = {byte: letter for letter, byte in byte_alphabet().items()}
        #: A word in lower case and what follows it, without apostrophes and special tokens.
        self.simple = re.compile(rb"([a-z]+)([^a-z0-9'<\s]*)").fullmatch
        self.pieces = Bounded(self._piece, 2 * REMEMBERED)
        self.parts = Bounded(self._part, REMEMBERED)

    def _piece(self, piece: str | bytes) -> bytes:
        data = piece if isinstance(piece, bytes) else piece.encode()
        found = self.tokenize("".join(map(self.letters.__getitem__, data)))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _part(self, part: bytes) -> bytes:
        if part.isascii():
            word = self.simple(part.lower())
            if word:
                letters, rest = word.groups()
                return self.pieces[letters] + self.pieces[rest] if rest else self.pieces[letters]
        text = part.decode()
        # The class of unprintable characters depends on the Unicode version, and a sigma's lower case on its place.
        if not text.isprintable() or "\u03a3" in text or any(s in text for s in self.specials):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, self.find(normalize("NFC", text).lower())))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, text.encode().split()))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write(
    docs: DataFrame, directory: str, path: str, end: int = 1, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Write the ids of every whole text, each followed by ``end``, into files below ``directory``, by ascending id.

    Returns the list of files (``number`` in the order of the ids, ``file``, ``first``: ids in all earlier files).
    A null text is empty and has the end id alone. Null ids come first; rows with one id follow each other by text.
    The texts are sorted by id over all tasks; each task writes its range, in files of bounded length. A repeated
    task writes the same files again, under a draft name until they are complete.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def store(batches):
        files, folder = fs.FileSystem.from_uri(directory)
        known, part = word_encoder(path), TaskContext.get().partitionId()
        last = np.array([end], "<u4").tobytes()
        writer, n_files, done = None, 0, []
        for batch in small_batches(batches, "text"):
            for document, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if writer is None:
                    name = f"part-{part:06d}-{n_files:06d}.s8b"
                    writer, n_files = Writer(files, f"{folder}/{name}"), n_files + 1
                    done.append([part * 1_000_000 + n_files, name, 0])
                writer.add(document, np.frombuffer(known.encode(text) + last, "<u4"))
                if writer.n_ids >= FILE_IDS:
                    writer.close()
                    done[-1][2], writer = writer.n_ids, None
        if writer is not None:
            writer.close()
            done[-1][2] = writer.n_ids
        numbers, names, sizes = (list(x) for x in zip(*done)) if done else ([], [], [])
        yield pa.record_batch(
            {
                "number": pa.array(numbers, pa.int64()),
                "file": pa.array([f"{directory}/{name}" for name in names], pa.string()),
                "n_ids": pa.array(sizes, pa.int64()),
            }
        )

    spark_folder = directory if "://" in directory else f"file://{directory}"
    files, folder = fs.FileSystem.from_uri(spark_folder)
    files.create_dir(folder, recursive=True)
    written = materialize(ordered.mapInArrow(store, "number long, file string, n_ids long"), "token-files")
    earlier = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("first", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))


def read(files: DataFrame) -> DataFrame:
    """The documents of token files: ``doc_id``, ``start`` (ids of all documents before it), ``ids`` (binary,
    little-endian unsigned 32-bit integers). ``files`` is the list that ``write`` returns."""
    return _scan(files, "ids binary", lambda parts: b"".join(p.astype("<u4").tobytes() for p in parts), pa.binary())


def checksums(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of the documents in token files."""

    def checksum(parts: list[np.ndarray]) -> int:
        value = 0
        for part in parts:
            value = zlib.crc32(part.astype("<u4").tobytes(), value)
        return value

    return _scan(files, "ids_crc32 long", checksum, pa.int64())


def _scan(files: DataFrame, column: str, digest, kind: pa.DataType) -> DataFrame:
    ship(files.sparkSession)
    name = column.split()[0]

    def scan(batches):
        for batch in batches:
            for uri, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
                files, path = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                for document, parts in Reader(files, path).texts():
                    length = sum(map(len, parts))
                    rows.append((document, first, length, digest(parts)))
                    first, held = first + length, held + length
                    if held >= 1 << 20:
                        yield _table(rows, name, kind)
                        rows, held = [], 0
                yield _table(rows, name, kind)

    return one_each(files.select("file", "first")).mapInArrow(scan, f"doc_id long, start long, n_tokens long, {column}")


def _table(rows: list[tuple], name: str, kind: pa.DataType) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows)] if rows else [[], [], [], []]
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), name: kind}
    return pa.record_batch({k: pa.array(c, t) for c, (k, t) in zip(columns, kinds.items())})
