"""Prefix trie and Merkle manifest against plain Python versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dqengine.llm import merkle, prefix_trie, sequences

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """Every prefix as a tuple in a table; subtrees by going through all nodes below."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0, role.encode(), digest), (role, text)))
    original = {c: [t for _, t in sorted(ts, key=lambda t: t[0])] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(original):
        h = zlib.crc32(str(c).encode()) % 4
        whole = original.get(c - int(math.fmod(c, 20)), [])[:h] + original[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, totals = [], {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [totals[c] for c in children[node]]
        leaves = sum(x for x, _ in below) or 1
        saved = (len(members[node]) - 1) * words + sum(x for _, x in below)
        totals[node] = leaves, saved
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves, saved, digest))
    return sorted(out, key=lambda r: (r[0], r[1]))


def conversations(seed: int, n: int, first: str | None = None):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, 6)):
            text = first if first and t == 0 and rnd.random() < 0.7 else rnd.choice(("a b", "c", "", "d e f", None))
            rows.append((c, t, rnd.choice(("user", "user", "bot")), text))
    return rows


def trie(spark, rows):
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as a", "2 as conv", "3 as part", "4 as depth")
    found = prefix_trie.prefix_trie(*prefix_trie.rebuilt_turns(df.repartition(3))).collect()
    return sorted(map(tuple, found), key=lambda r: (r[0], r[1]))


def test_trie_equals_plain_version(spark):
    rnd = random.Random(4)
    rows = conversations(2, 150, "hello there you")
    rows = [r for r in rows if r[0] not in (20, 60)]  # their blocks have no first conversation
    rows += [(c, t, "user", f"copy {t}") for c in (200, 220, 221, 222, 240) for t in range(5)]
    rows += [(300, None, "user", "no turn"), (300, 1, None, None), (300, 1, "user", "same turn"), (None, 1, "user", "x")]
    rows += [(-7, 0, "user", "below zero"), (-7, 1, "bot", "yes"), (301, 5, "user", "one"), (7, 0, "user", "x y")]
    rnd.shuffle(rows)
    assert trie(spark, rows) == plain_trie(rows)
    assert trie(spark, []) == []


def test_trie_in_many_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURN_BITS", 2)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2)
    monkeypatch.setattr(sequences, "CHUNK_BITS", 4)
    monkeypatch.setattr(sequences.list_ranks, "__defaults__", (4,))
    rows = conversations(3, 90, "hello") + [(500, t, "user", f"long {t}") for t in range(40)]
    rows += [(c, t, "user", f"copy {t}") for c in range(600, 660) for t in range(2)]
    assert trie(spark, rows) == plain_trie(rows)


@pytest.mark.parametrize("local", [True, False])
def test_list_ranks(spark, local):
    order = list(range(5000))
    if not local:  # neighbours in the list are in different blocks, so pointers jump
        random.Random(1).shuffle(order)
    rows = [(a, b, 1) for a, b in zip(order, order[1:])] + [(order[-1], -1, 0)]
    links = spark.createDataFrame(rows, "item long, next long, hops long").repartition(4)
    got = dict(map(tuple, sequences.list_ranks(links, order[0], 6).select("item", "rank").collect()))
    assert got == {item: len(order) - 1 - i for i, item in enumerate(order)}


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(sequences, "CHUNK_BITS", 3)
    rows = spark.range(1000).select(F.col("id").alias("place"), (F.col("id") % 7).alias("v"))
    got = sequences.running(rows, "place", ["v"]).orderBy("place").collect()
    total = 0
    for r in got:
        total += r.v
        assert r.v_upto == total


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def plain_manifest(rows):
    """Whole levels as lists; the proof of a leaf by walking up from it."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda row: h(*map(field, row))

    def levels(nodes):
        out = [nodes]
        while len(nodes) > 1:
            nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            out.append(nodes)
        return out

    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        for place, row in enumerate(ordered):
            doc, source, lang, n, text = row
            more = doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0
            node, proof = leaf((doc, source, lang, n + 1, text)) if more else leaf(row), []
            for tree, i in ((trees[g], place), (top, at)):
                for level in tree[:-1]:
                    run = level[i - i % 2 : i - i % 2 + 2]
                    proof += run[: i % 2] + run[i % 2 + 1 :]
                    node = h(*run[: i % 2], node, *run[i % 2 + 1 :])
                    i //= 2
            root = top[-1][0]
            out.append((doc, leaf(row), trees[g][-1][0], root, h(*proof), node, node == root))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("levels", [10, 2])
def test_manifest_equals_plain_version(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rnd = random.Random(6)
    for langs in (["en", "en", "en", "dé", "fr", None, "", "z"], ["en"]):
        rows = [(i, rnd.choice(("a", None)), rnd.choice(langs), rnd.choice((None, i)), rnd.choice((None, "", f"té {i}"))) for i in range(90)]
        rows += [(5, "a", "en", 5, "same")] * 3 + [(5, "b", "en", 5, "other"), (None, None, None, None, None), (None, "x", "en", 1, "y")]
        rows += [(1000, "a", "only", 1, "alone")] if len(langs) > 1 else []
        df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as id", "2 as place", "3 as n", "4 as leaf", "5 as root")
        got = merkle.verified_documents(df.repartition(3)).collect()
        assert sorted(map(tuple, got), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:])) == plain_manifest(rows)
        assert {r.verified for r in got} == {True, False}
    one = [(3, "a", "en", 1, "x")]
    assert [tuple(r) for r in merkle.verified_documents(spark.createDataFrame(one, DOCS)).collect()] == plain_manifest(one)
    assert merkle.verified_documents(spark.createDataFrame([], DOCS)).collect() == []
