from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = ("n_words", "host", "digest", "row", "copies", "size", "bits", "ids", "u", "group", "number", "key")


def words(rnd: random.Random, n: int) -> str:
    sep = (" ", " ", " ", "  ", "\n", "\t")
    return "".join(rnd.choice(("the", "Cat", "sat", "on", "mat", "été", "x9", "a")) + rnd.choice(sep) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    rnd = random.Random(5)
    plain = words(rnd, 60)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, plain, "en", "a", len(plain)),
        (4, plain, "en", "a", len(plain)),  # a repeated row
        (4, plain + " other", "en", "b", 9),  # an id with another text
        (5, plain, "fr", "b", len(plain)),
        (None, plain, "fr", None, 3),
        (None, "no id", None, "c", 5),
        (6, words(rnd, 30_000), "de", "c", 1),
        (7, "x" * 200_000, "de", "c", 200_000),
        (8, "Ünïcode \U0001f600 <|endoftext|> it's\r\n\r\nx  y", "es", "a", 40),
    ]
    return rows + [(100 + i, words(rnd, rnd.randint(1, 80)), "en", rnd.choice("abc"), 1) for i in range(60)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """Documents with nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    docs = spark.createDataFrame(edge_rows, DOCS)
    for name in CLASHES:
        docs = docs.selectExpr("*", f"'clash' as {name}")
    return docs.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
