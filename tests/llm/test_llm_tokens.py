"""BPE by chunks, prefix counts and token files, against the libraries."""

from __future__ import annotations

import random
import zlib

import numpy as np
import plain
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dqengine.llm import bpe, prefix_counts, token_files
from dqengine.session import scratch_path

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = [
    "a", "the", "The", " ", "  ", "\n", "\n\n", "'", "'s", "'re", "'l", "ll", "1", "23", "!", "--", "é", "É", "日",
    "́", "\U0001f600", "\t", "<|endoftext|>", "<|endo", "_", "====", "\xa0", "\x1c", "\x85", "ing", " th", "\x00",
    "Σ", "ΑΣ", "İ", "K", "ﬁ", "²", "՘", " ",
]


def texts(n: int, seed: int, longest: int = 12) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("chunk, overlap", [(7, 3), (20, 16), (64, 1)])
def test_stitched_scans_are_those_of_the_whole_text(chunk, overlap):
    find = bpe.vocabulary(RANKS, PATTERN).split
    for text in [*texts(400, 1, 60), "x" * 500, " " * 300 + "a", "ab " * 100]:
        starts = range(0, max(len(text), 1), chunk)
        scans = [
            (s, min(s + chunk + overlap, len(text)), bpe.ends(find, text[s : s + chunk + overlap], s)) for s in starts
        ]
        assert bpe.stitch(find, text, scans) == bpe.ends(find, text), repr(text)


def test_bpe_equals_the_library(spark, edge_docs, edge_rows):
    for chunk in (bpe.CHUNK, 1000):
        encoded = bpe.encode(edge_docs, RANKS, PATTERN, chunk=chunk, overlap=64)
        got = bpe.decode(encoded, RANKS, PATTERN).collect()
        known = plain.byte_encoding_cached()
        want = [(i, np.array(known.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in edge_rows]
        key = lambda r: (r[0] is None, r[0] or 0, r[2])
        assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got), key=key) == sorted(want, key=key)


def test_bpe_random_texts(spark):
    rows = list(enumerate(texts(500, 2, 40)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, RANKS, PATTERN).collect()}
    assert got == {i: plain.digests(t) for i, t in rows}


def test_bpe_of_no_documents(no_docs):
    assert bpe.digests(no_docs, RANKS, PATTERN).collect() == []


def test_every_prefix_count():
    counter, library = prefix_counts.counter(BYTES), Tokenizer.from_file(BYTES)
    for text in texts(800, 3):
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.counts(text).tolist() == want, repr(text)


def test_ascii_and_general_split_agree():
    counter, rnd = prefix_counts.counter(BYTES), random.Random(4)
    for _ in range(5000):
        text = "".join(chr(rnd.choice([rnd.randrange(128), 32, 39, 97, 10])) for _ in range(12))
        assert counter.find_ascii(text) == counter.find_any(text)


def test_counts_and_truncation(spark, edge_docs, edge_rows, no_docs):
    library = Tokenizer.from_file(BYTES)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    counted = prefix_counts.prefix_counts(edge_docs, BYTES).withColumn("n", prefix_counts.total(F.col("counts")))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n) for r in counted.collect())
    assert got == sorted((i or 0, len((t or "").encode()), n(t or "")) for i, t, *_ in edge_rows)
    small = edge_docs.filter("length(text) < 500 or text is null")
    places = prefix_counts.prefix_counts(small, BYTES).select(
        "doc_id", prefix_counts.longest_prefix(F.col("counts"), 10).alias("n")
    )
    kept = prefix_counts.truncate(small, BYTES, 10).collect()
    assert sorted((r.doc_id or 0, r.n) for r in places.collect()) == sorted((r.doc_id or 0, len(r.text)) for r in kept)
    whole = {}
    for i, t, *_ in edge_rows:
        whole.setdefault(i, []).append(t or "")
    for r in kept:
        text = next(t for t in whole[r.doc_id] if t.startswith(r.text))
        assert n(r.text) <= 10 and all(n(text[:i]) > 10 for i in range(len(r.text) + 1, len(text) + 1))
    assert prefix_counts.prefix_counts(no_docs, BYTES).collect() == []


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300))
@settings(max_examples=200, deadline=None)
def test_words_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, raw = token_files.pack(ids)
    assert token_files.unpack(words, raw).tolist() == ids.tolist()
    assert token_files.bit_lengths(ids).tolist() == [int(i).bit_length() for i in ids]


def test_file_reads_any_range(tmp_path):
    rnd, files = np.random.default_rng(1), fs.LocalFileSystem()
    documents = [rnd.integers(0, 49_408, n, dtype=np.uint32) for n in (0, 5, 40_000, 1, 16_384, 300)]
    writer = token_files.Writer(files, f"{tmp_path}/a.s8b")
    for i, ids in enumerate(documents):
        writer.add(None if i == 3 else i, ids)
    writer.close()
    reader = token_files.Reader(files, f"{tmp_path}/a.s8b")
    whole = np.concatenate(documents)
    for a, b in ((0, 0), (0, 5), (10, 17_000), (16_383, 16_385), (len(whole) - 1, len(whole))):
        assert reader.ids(a, b).tolist() == whole[a:b].tolist()
    got = [(d, np.concatenate([*parts, np.zeros(0)]).tolist()) for d, parts in reader.texts()]
    assert got == [(None if i == 3 else i, ids.tolist()) for i, ids in enumerate(documents)]


def test_word_encoder_equals_the_library():
    encoder, library = token_files.word_encoder(WORDS), Tokenizer.from_file(WORDS)
    for text in texts(3000, 6):
        got = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files(spark, edge_docs, edge_rows, no_docs):
    library = Tokenizer.from_file(WORDS)
    files = token_files.write(edge_docs, scratch_path(spark, "tokens"), WORDS)
    checked = token_files.checksums(files).collect()
    rows = sorted(((i is not None, i or 0, t or "") for i, t, *_ in edge_rows))
    want, start = [], 0
    for known, i, text in rows:
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        want.append((i if known else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in checked]
    assert sorted(got, key=lambda r: r[1]) == want
    read = {r.start: bytes(r.ids) for r in token_files.read(files).collect()}
    assert {s: zlib.crc32(b) for s, b in read.items()} == {r[1]: r[3] for r in want}
    assert token_files.checksums(token_files.write(no_docs, scratch_path(spark, "none"), WORDS)).collect() == []
