"""Quality rules, mixing, near-duplicates and the pipeline, against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
import plain
import pytest
from conftest import DOCS
from pyspark.sql import functions as F

from dqengine.llm import line_quality, links, mixing, simhash
from dqengine.llm.line_quality import Limits

SMALL = Limits(line_documents=3)


@pytest.fixture(scope="module")
def corpus():
    """Ordinary documents, some made of lines that many share, and groups of exact and near copies."""
    rnd = random.Random(9)
    vocabulary = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "rd", "st", "m", "")]
    sentence = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    shared = [f"Released  under licence {i} of 2021" for i in range(4)]
    rows = []
    for i in range(120):
        lines = [sentence(rnd.randint(4, 12)) for _ in range(rnd.randint(3, 9))]
        if i % 3 == 0:
            lines.insert(rnd.randrange(len(lines)), shared[i % 4].replace("2021", str(1900 + i)))
        if i % 10 == 0:
            lines = [*shared, sentence(3)]
        if i % 17 == 0:
            lines = lines[:2] * 5
        rows.append((i, "\n".join(lines), "en", rnd.choice(("a", "b", None)), 1))
    original = "\n".join(sentence(30) for _ in range(12))
    for i in range(200, 260):
        text = original.split(" ")
        text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(text) if i % 2 else original, "en", "a", 1))
    return rows


def test_measures_and_verdicts(spark, corpus, edge_rows):
    for rows, limits in ((corpus, SMALL), (edge_rows, Limits())):
        docs = spark.createDataFrame(rows, DOCS)
        got = line_quality.line_quality(docs, limits=limits).collect()
        frequent = plain.frequent_lines([(r[1], r[3]) for r in rows], limits.line_documents)
        want = [(i, h, *plain.base(t), *plain.verdict(t, h, frequent)) for i, t, _, h, _ in rows]
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(
            ((r.doc_id, r.host, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
              r.base_failed, r.kept, r.removed_words) for r in got), key=key,
        ) == sorted(want, key=key)
        if rows is corpus:
            assert any(frequent.values()) and any(not r.kept and not r.base_failed for r in got)
            assert all(r.kept for r in got if r.doc_id >= 200)  # copies are not boilerplate


def test_cleaning_both_ways(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS)
    frequent = plain.frequent_lines([(r[1], r[3]) for r in corpus], 3)
    want = Counter()
    for i, text, lang, host, n in corpus:
        failed, kept, removed = plain.verdict(text, host, frequent)
        if kept:
            new = plain.cleaned(text, host, frequent) if removed else text
            want[i, new, lang, host, len(new) if removed else n] += 1
    for limits in (SMALL, Limits(line_documents=3, broadcast_lines=0)):
        kept = line_quality.clean(docs, length_column="n_chars", limits=limits)
        assert kept.schema.simpleString() == docs.schema.simpleString()
        assert Counter(map(tuple, kept.collect())) == want


@pytest.mark.parametrize("own", [20, 60, 150])
def test_different_documents_of_one_passage_count_each(spark, own):
    rnd = random.Random(own)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    passage = [" ".join(word() for _ in range(30)) for _ in range(10)]
    rows = [(i, "\n".join([*passage, " ".join(word() for _ in range(own))]), "en", "a", 1) for i in range(100)]
    family = [" ".join(word() for _ in range(30)) for _ in range(12)]
    for i in range(100, 200):  # copies with a word changed: one document, or few
        text = " ".join([*family]).split(" ")
        text[15] = word()
        text = [" ".join(text[a : a + 30]) for a in range(0, 360, 30)]
        rows.append((i, "\n".join(text), "en", None, 1))
    got = line_quality.line_quality(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.removed_words for r in got if r.doc_id < 100} == {300}
    assert all(r.kept == (own >= 0.2 * (300 + own)) for r in got if r.doc_id < 100)
    assert all(r.kept and not r.removed_words for r in got if r.doc_id >= 100)


@pytest.mark.parametrize("n, batch, keys", [(200, 32, 1_000_000), (1000, 8, 0)])
def test_near_copies_are_treated_like_exact_ones(spark, monkeypatch, n, batch, keys):
    """Five words of 300 changed at random places in each copy, beside different documents with one line of theirs."""
    monkeypatch.setattr(line_quality, "BATCH", batch)
    monkeypatch.setattr(line_quality, "MOST_KEYS", keys)
    rnd = random.Random(n)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    lines = [[word() for _ in range(30)] for _ in range(10)]
    rows = []
    for i in range(n):
        copy = [list(line) for line in lines]
        for place in rnd.sample(range(300), 5):
            copy[place // 30][place % 30] = word()
        rows.append((i, "\n".join(map(" ".join, copy)), "en", "near", 1))
        rows.append((n + i, "\n".join(map(" ".join, lines)), "en", "exact", 1))
    common = " ".join(lines[0])
    rows += [(10_000 + i, common + "\n" + " ".join(word() for _ in range(60)), "en", "near", 1) for i in range(60)]
    got = line_quality.line_quality(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.kept for r in got if r.doc_id < 10_000) and not any(r.removed_words for r in got if n <= r.doc_id < 2 * n)
    assert {r.removed_words for r in got if r.doc_id < n} == {0, 30}  # only the line that others have too
    assert {r.removed_words for r in got if r.doc_id >= 10_000} == {30}


def test_limit_does_not_grow_with_the_host(spark):
    rnd = random.Random(8)
    text = lambda: " ".join("".join(rnd.choice("abcdefghijkl") for _ in range(6)) for _ in range(25))
    hot = lambda i: "\nA line of few among many" if i % 3 == 0 and i < 270 else "\nA rare line" if 300 <= i < 360 else ""
    rows = [(i, text() + hot(i), "en", "hot" if i % 3 == 0 else f"h{i % 30}", 1) for i in range(6000)]
    got = line_quality.line_quality(spark.createDataFrame(rows, DOCS)).collect()  # 90 of the 2,000 documents of "hot"
    assert {r.doc_id for r in got if r.removed_words} == set(range(0, 270, 3))


def test_quality_edges(spark, edge_docs, no_docs):
    assert line_quality.clean(edge_docs).columns == edge_docs.columns
    assert line_quality.line_quality(edge_docs).count() == edge_docs.count()
    assert line_quality.line_quality(no_docs).collect() == [] and line_quality.clean(no_docs).collect() == []


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 1000, None: 5}, {"a": 0, "b": 7}, {"a": 0}])
def test_targets(spark, sizes):
    table = spark.createDataFrame([*sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    assert got == pytest.approx(plain.fill(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix(spark, corpus, edge_docs, edge_rows, no_docs):
    for rows, docs in ((corpus, spark.createDataFrame(corpus, DOCS)), (edge_rows, edge_docs)):
        want = Counter((r[0], len(plain.WORD.findall(r[1] or "")), c) for r, c in zip(rows, plain.mix([(r[0], r[1], r[3]) for r in rows])))
        got = mixing.allocate(docs).collect()
        assert Counter((r.doc_id, r.size, r.copies) for r in got) == want
        assert all(r.taken == r.size * r.copies <= 3 * r.size for r in got)
        assert got and sorted(map(str, got)) == sorted(map(str, mixing.allocate(docs.repartition(5)).collect()))
        mixed = mixing.mix(docs)
        assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
        taken, target = defaultdict(int), {}
        for r in got:
            taken[r.source] += r.taken
            target[r.source] = r.target
        if rows is corpus:
            assert all(abs(taken[s] - target[s]) < 0.05 * target[s] for s in target)
    assert mixing.allocate(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []


def test_rows_of_one_id_close_the_gap_together(spark):
    rows = [(i, "w " * 3000, "en", "ab"[i % 2], 1) for i in range(1200)]
    rows += [(None, "w " * 500, "en", s, 1) for s in "ab" for _ in range(1000)]
    docs = spark.createDataFrame(rows, DOCS)
    late = [seed for seed in range(200) if plain.random_number(None, seed) > 0.9][:3]  # null ids rank behind the cut
    for seed in late:
        got = mixing.allocate(docs, seed=seed).groupBy("source")
        for r in got.agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
            assert abs(r.taken - r.target) <= 1500


def test_probabilities_are_unequal_and_add_up(spark):
    """Shorter documents are more probable, the expected words are those wanted, and that changes the ranking."""
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.choice((5, 50, 500)), "en", "ab"[i % 2], 1) for i in range(3000)]
    got = mixing.allocate(spark.createDataFrame(rows, DOCS)).filter("source = 'a'").collect()
    whole = min(r.copies for r in got)
    share = {n: sum(r.copies - whole for r in got if r.size == n) / sum(r.size == n for r in got) for n in (5, 50, 500)}
    assert share[5] > share[50] > share[500] > 0
    by_u = sorted(got, key=lambda r: plain.random_number(r.doc_id))
    extra = [r.copies > whole for r in by_u]
    assert extra != sorted(extra, reverse=True)  # not simply those with the smallest numbers
    assert abs(sum(r.taken for r in got) - got[0].target) < 5


def test_what_does_not_fit_is_passed_over(spark):
    """One very long document early in the ranking leaves its place to those that fit."""
    long = min(range(400), key=plain.random_number)
    rows = [(i, "w " * (20_000 if i == long else 10), "en", "a", 1) for i in range(400)]
    rows += [(1000 + i, "w " * 10, "en", "b", 1) for i in range(1900)]
    got = mixing.allocate(spark.createDataFrame(rows, DOCS)).collect()
    want = plain.mix([(r[0], r[1], r[3]) for r in rows])
    assert Counter((r.doc_id, r.copies) for r in got) == Counter((r[0], c) for r, c in zip(rows, want))


def test_preference_raises_the_odds(spark):
    rows = [(i, "one two three", "ab"[i % 2], 9.0 if i % 4 < 2 else 1.0) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, liked double")
    got = mixing.allocate(docs, preference_column="liked").filter("source = 'a'").collect()
    liked = sum(r.copies for r in got if r.doc_id % 4 < 2)
    assert liked > 2 * sum(r.copies for r in got if r.doc_id % 4 >= 2) > 0


def test_fingerprints_and_components(spark, corpus, edge_docs, edge_rows, no_docs):
    for rows, docs in ((corpus, spark.createDataFrame(corpus, DOCS)), (edge_rows, edge_docs)):
        prints = [plain.fingerprint(r[1]) for r in rows]
        group = plain.groups(prints, 2)
        smallest = defaultdict(list)
        for r, g in zip(rows, group):
            smallest[g].append(r[0])
        ids = {g: min((i for i in found if i is not None), default=None) for g, found in smallest.items()}
        want = Counter((r[0], f"{p:016x}", ids[g]) for r, p, g in zip(rows, prints, group))
        got = simhash.near_duplicates(docs).collect()
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
        kept = simhash.drop_near_duplicates(docs)
        assert kept.columns == docs.columns and kept.count() == len(ids)
        assert Counter(r.doc_id for r in kept.collect()) == Counter(ids.values())
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.drop_near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("most_bits", [0, 1, 2, 3])
@pytest.mark.parametrize("segments", [1, 2, 4])
@pytest.mark.parametrize("alike", [64, 1])
def test_links_connect_what_is_near(spark, monkeypatch, most_bits, segments, alike):
    if segments == 2 and most_bits // segments > 1:
        return
    monkeypatch.setattr(simhash, "MOST_ALIKE", alike)
    rnd = random.Random(most_bits)
    prints = set()
    for _ in range(12):
        one = rnd.getrandbits(64)
        for _ in range(25):  # a walk: neighbours are near, ends are far apart
            prints.add(one)
            for _ in range(rnd.randint(0, 4)):
                one ^= 1 << rnd.randrange(64)
    prints = sorted(prints)
    table = spark.createDataFrame([(plain.signed(p),) for p in prints], "bits long")
    found = simhash.links(table, most_bits, segments)
    assert found.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > most_bits).count() == 0
    roots = {r.node: r.root for r in links.components(found).collect()}
    mine = defaultdict(set)
    for p in prints:
        mine[roots.get(plain.signed(p), plain.signed(p))].add(p)
    want = defaultdict(set)
    for p, g in zip(prints, plain.groups(prints, most_bits)):
        want[g].add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_candidates_of_a_segment_are_verified(spark):
    """The same lower half, and an upper half that differs in three bits: found in the table, and rejected."""
    base = 0x0123456789ABCDEF
    prints = [base, base ^ (0b111 << 40), base ^ (0b11 << 50)]
    table = spark.createDataFrame([(plain.signed(p),) for p in prints], "bits long")
    keys = table.select(simhash.segment_keys(2, 0).alias("key")).groupBy("key").count().filter("count > 1")
    assert keys.count() == 1
    found = [(r.a, r.b) for r in simhash.links(table, 2).collect()]
    assert found == [tuple(sorted((plain.signed(prints[0]), plain.signed(prints[2]))))]


def test_a_group_of_near_copies_lists_no_pairs(spark):
    rnd = random.Random(3)
    prints = {0} | {1 << i | 1 << j for i in range(64) for j in range(i)}
    table = spark.createDataFrame([(plain.signed(p),) for p in prints], "bits long")
    found = simhash.links(table, 2)
    assert found.count() <= 65 * len(prints)
    assert {r.root for r in links.components(found).collect()} == {min(plain.signed(p) for p in prints)}
    assert rnd


def test_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in links.components(chain).collect()} == {0}


def test_pipeline(spark, corpus, tmp_path):
    spark.createDataFrame(corpus, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    limits = Limits()
    frequent = plain.frequent_lines([(r[1], r[3]) for r in corpus], limits.line_documents)
    good = []
    for i, text, _, host, _ in corpus:
        _, kept, removed = plain.verdict(text, host, frequent)
        if kept:
            good.append((i, plain.cleaned(text, host, frequent) if removed else text, host))
    group = plain.groups([plain.fingerprint(t) for _, t, _ in good], 2)
    best = {}
    for row, g in zip(good, group):
        best[g] = min(best.get(g, row), row, key=lambda r: r[0])
    rows = list(best.values())
    want = Counter()
    for (i, text, _), copies in zip(rows, plain.mix(rows)):
        if copies:
            want[i, *plain.digests(text)] += copies
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == want and want


def test_stages_accept_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        at = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, "")
            assert at.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, at, "").count() == at.count()
