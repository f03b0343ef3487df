"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

The BPE encoding of a byte string ends with the one token that follows on from the encoding of what stands before
it, so the last token and the count of every prefix come from those of shorter prefixes: of all tokens that end at a
place, that one is right whose neighbour, the last token before it, would not have merged with it in any way. The
counts of a pre-token's prefixes are the same wherever it stands, so they are computed once and remembered, and those
of a text are put together from them. Questions of length and budget need no encoding any more.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers.pre_tokenizers import ByteLevel

from dqengine.llm.common import Bounded, byte_alphabet, ship, small_batches, stand_ins, whole_text

#: Pre-tokens, and pairs of tokens, a Python worker remembers.
REMEMBERED = 700_000
#: A pair of tokens is one number.
PAIR = 1 << 24

# The split of byte-level pre-tokenisers, and its parts that need care at the end of a prefix.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixCounter:
    """Counts for a byte-level BPE file of the tokenizers library, without added begin or end tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        model = spec["model"]
        vocabulary = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items()}
        names = {token: i for token, i in model["vocab"].items()}
        #: Rank and result of each merge, by its two tokens.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, made = (names[left], names[right]), names[left + right]
            self.merges[pair] = (rank, made)
            self.parts.setdefault(made, pair)
        self.single = {token[0]: i for token, i in vocabulary.items() if len(token) == 1}
        #: Tokens by their bytes from the last to the first; None marks a whole token.
        self.backwards: dict = {}
        for token, i in vocabulary.items():
            node = self.backwards
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[None] = i
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.specials = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.find_any = regex.compile(PATTERN).findall
        self.find_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        library = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.shadow = stand_ins(lambda c: any(len(library(x + c)) == 1 for x in "a1"))
        self.double_space = regex.compile(r"\s\s").search
        self.spines: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.fits = Bounded(self._fits, REMEMBERED)
        self.whole = Bounded(self._whole, REMEMBERED)
        self.inner = Bounded(self._inner, REMEMBERED)

    def _rank(self, token: int) -> float:
        """When a token is made; single bytes are there from the start."""
        return self.merges[self.parts[token]][0] if token in self.parts else -1

    def _spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The parts at one end of a token, from the token itself down, each with the rank that uses it up."""
        if (token, right) not in self.spines:
            spine, until, part = [], float("inf"), token
            while True:
                spine.append((part, until))
                if part not in self.parts:
                    break
                until, part = self._rank(part), self.parts[part][1 if right else 0]
            self.spines[token, right] = spine
        return self.spines[token, right]

    def _fits(self, pair: int) -> bool:
        """Whether two tokens stay side by side: no merge across their border comes before those inside them.

        Of equal ranks the left place merges first, so an equal rank counts inside the left token, not the right.
        """
        merges = self.merges
        left, right = divmod(pair, PAIR)
        for x, x_until in self._spine(left, True):
            for y, y_until in self._spine(right, False):
                across = merges.get((x, y))
                if across and across[0] < x_until and across[0] <= y_until:
                    return False
        return True

    def _whole(self, token: int) -> bool:
        """Whether the bytes of a token encode to the token itself."""
        if token not in self.parts:
            return True
        left, right = self.parts[token]
        if not (self._whole(left) and self._whole(right)):
            return False
        rank = self._rank(token)
        for x, x_until in self._spine(left, True):
            for y, y_until in self._spine(right, False):
                across = self.merges.get((x, y))
                if across and across[0] < rank and across[0] < x_until and across[0] <= y_until:
                    return False
        return True

    def byte_counts(self, data: bytes) -> list[int]:
        """Number of tokens of every prefix of one pre-token's bytes; the first is the empty one."""
        last, count = [0] * (len(data) + 1), [0] * (len(data) + 1)
        fits, whole, root = self.fits, self.whole, self.backwards
        for end in range(1, len(data) + 1):
            node, at, found = root, end, []
            while at:
                node = node.get(data[at - 1])
                if node is None:
                    break
                at -= 1
                token = node.get(None)
                if token is not None:
                    found.append((at, token))
            for at, token in reversed(found):
                if fits[last[at] * PAIR + token] if at else whole[token]:
                    last[end], count[end] = token, count[at] + 1
                    break
        return count

    def _inner(self, piece: str) -> bytes:
        """Counts after each character of a pre-token, as 32-bit integers."""
        data = piece.encode()
        counts = self.byte_counts(data)
        if piece in LONG_CONTRACTIONS:  # without its last letter it is two pre-tokens
            counts[2] = 2
        if len(data) == len(piece):
            return struct.pack(f"={len(data)}i", *counts[1:])
        # A character ends before each byte that does not continue one.
        ends = [i for i in range(1, len(data)) if data[i] & 0xC0 != 0x80]
        return struct.pack(f"={len(piece)}i", *[counts[i] for i in ends], counts[-1])

    def _plain(self, text: str) -> np.ndarray:
        """Counts after each character of a text without special tokens."""
        if not text:
            return np.zeros(0, np.int32)
        shadow = self.shadow(text)
        pieces = (self.find_ascii if text.isascii() else self.find_any)(shadow)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stops = np.cumsum(lengths)
        if shadow is not text:
            pieces = [text[b - n : b] for b, n in zip(stops.tolist(), lengths.tolist())]
        inner = list(map(self.inner.__getitem__, pieces))
        counts = np.frombuffer(bytearray().join(inner), np.int32)
        totals = np.cumsum(counts[stops - 1], dtype=np.int32)
        before = np.concatenate([[0], totals[:-1]]).astype(np.int32)
        counts += np.repeat(before, lengths)
        if self.double_space(text):
            # A run of white space before a word leaves its last character to the next pre-token, but a prefix
            # that ends with that character has the whole run in one.
            for i, piece in enumerate(pieces[:-1]):
                if piece.isspace() and pieces[i + 1][0].isspace():
                    counts[stops[i]] = before[i] + self.byte_counts((piece + pieces[i + 1][0]).encode())[-1]
        return counts

    def counts(self, text: str) -> np.ndarray:
        """Number of tokens of every prefix of a text, by characters; the first is the empty one.

        A special token's string is one token where it is complete; up to there it is ordinary text.
        """
        out, start = [np.zeros(1, np.int32)], 0
        total = np.int32(0)
        for match in self.specials.finditer(text) if self.specials else ():
            part = self._plain(text[start : match.end() - 1])
            own = self._plain(text[start : match.start()])
            out.append(part + total)
            total += (own[-1] if len(own) else 0) + 1
            out.append(np.array([total], np.int32))
            start = match.end()
        out.append(self._plain(text[start:]) + total)
        return np.concatenate(out)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_bytes`` (of the text in UTF-8) and ``counts`` of every whole text.

    ``counts[i]`` is the exact number of tokens of the text's first i characters, so its first is 0 and its last the
    number of tokens of the text. A null text is empty. Null ids and repeated rows are kept; other columns are not
    read. The tokenizer file is read on every executor from ``path``.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), whole_text(text_column).alias("text"))
    schema = T.StructType(
        [rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("counts", T.ArrayType(T.IntegerType()))]
    )

    def compute(batches):
        known = counter(path)
        for batch in small_batches(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            found = [known.counts(text) for text in texts]
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "counts": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())),
                }
            )

    return rows.mapInArrow(compute, schema)


def total(counts: Column) -> Column:
    """Number of tokens of the whole text."""
    return F.element_at(counts, -1).cast("long")


def longest_prefix(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens (0 or more)."""
    return F.size(counts) - F.array_position(F.reverse(F.transform(counts, lambda c: c <= budget)), True)


def truncate(
    docs: DataFrame, path: str, budget: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id`` and ``text``, cut to the longest prefix of at most ``budget`` tokens."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), whole_text(text_column).alias("text"))

    def cut(batches):
        known = counter(path)
        for batch in small_batches(batches, "text"):
            texts = [t[: int(np.flatnonzero(known.counts(t) <= budget)[-1])] for t in batch.column("text").to_pylist()]
            yield batch.set_column(1, "text", pa.array(texts, pa.string()))

    return rows.mapInArrow(cut, rows.schema)
