"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path
from unicodedata import category

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import dqengine

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole_text(name: str) -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that the table does not use yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


@lru_cache(maxsize=8)
def _shipped(application: str) -> str:
    package = Path(dqengine.__file__).resolve().parent
    return shutil.make_archive(
        f"{tempfile.mkdtemp()}/{package.name}", "zip", root_dir=package.parent, base_dir=package.name
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application."""
    context = spark.sparkContext
    before = _shipped.cache_info().misses
    archive = _shipped(context.applicationId)
    if _shipped.cache_info().misses > before:
        context.addPyFile(archive)


class Bounded(dict):
    """A cache that computes what it misses and starts afresh when it is full.

    ``map(cache.__getitem__, keys)`` stays in C for hits.
    """

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def young_letters() -> list[str]:
    """Letters and numbers of ``regex`` that the Unicode version of Python's own database does not know yet."""
    known = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    return [c for c in regex.findall(r"[\p{L}\p{N}]", known) if category(c) == "Cn"]


def stand_ins(joins: Callable[[str], bool]) -> Callable[[str], str]:
    """A function that makes ``regex`` split a text like a library with an older Unicode version.

    ``joins`` says whether the library takes a character as a letter or number. Those that it does not are replaced
    by a character of no class, so the result has the places of the text.
    """
    odd = sorted(ord(c) for c in young_letters() if not joins(c))
    if not odd:
        return lambda text: text
    breaks = [i for i in range(1, len(odd)) if odd[i] != odd[i - 1] + 1]
    ranges = [(odd[a], odd[b - 1]) for a, b in zip([0, *breaks], [*breaks, len(odd)])]
    found = regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")
    return lambda text: found.sub("\ue000", text) if not text.isascii() and found.search(text) else text


def one_each(files: DataFrame) -> DataFrame:
    """A list of files dealt out one to a task. A few rows that stand for much work would else share one task."""
    return files.repartition(max(1, files.count()))


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20):
    """Cut Arrow batches so that the texts of one piece stay near ``most_bytes``; a longer text is a piece alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)
