"""Quality rules from repetition: inside a text, and of lines across the documents of a host.

All of it is DataFrame work. Lines are normalised (lower case, runs of white space as one space, runs of digits as
one 0) and hashed. A line that occurs in more different documents of a host than allowed is removed, and a document
that keeps too little is rejected. Copies of one document, also with a few words changed, count as one document, so
that a group of copies does not make its own lines look like boilerplate.

The different documents of a line are counted by one rule, whatever their number: its texts are gone through in the
order of their hashes, and a text counts unless it is a copy (but for scattered words, see ``_near``) of one that
counted before. Whole texts are compared. The count stops when it is over the limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqengine.llm.common import GAP, whole_text
from dqengine.session import materialize

WINDOW = 8
#: Texts of a line that one round goes through; at least as many as the limit and a few, or most lines take two rounds.
BATCH = 32
#: Up to so many keys go to all tasks instead of shuffling all texts.
MOST_KEYS = 1_000_000
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    """``min_words``, ``max_repeat_percent``: rules inside a text.

    A line is removed when more than ``line_documents`` different documents of its host have it, however large the
    host is. A document is rejected when less than ``keep_share`` of its words are left.
    ``broadcast_lines``: up to so many removable lines go to all tasks; more are joined by a shuffle, with the same
    result.
    """

    min_words: int = 20
    max_repeat_percent: int = 30
    line_documents: int = 20
    keep_share: float = 0.2
    broadcast_lines: int = 10_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def _plain_lines(text: Column) -> Column:
    """The normalised lines of a text; one for each line, empty if it holds no word."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]+", "0")
    return F.transform(F.split(F.lower(plain), "\n", -1), lambda x: F.trim(x))


def _covered(hashes: Column) -> Column:
    """Number of words inside windows found twice or more; ``hashes`` are those of all windows, in order."""

    def starts(places: Column) -> Column:
        again = F.filter(
            places, lambda x, i: (F.get(places, i - 1)["h"] == x["h"]) | (F.get(places, i + 1)["h"] == x["h"])
        )
        return F.sort_array(F.transform(again, lambda x: x["at"]))

    def words(at: Column) -> Column:
        spans = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(spans, F.lit(0), lambda a, b: a + b)

    places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    found = _let(_let(places, starts), words)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)


def measure(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
    carry_row: bool = False,
) -> DataFrame:
    """One slim row per document, without its text.

    ``doc_id``, ``host``, ``digest`` (hash of the text), ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (long), ``lines`` (hash and words of each normalised line that has a word). A null text is
    empty: no words, no lines. Null ids and hosts are kept; documents without a host share one. ``carry_row`` adds the
    whole input row as the struct ``row``.
    """
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry_row else []
    rows = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        F.col(f"`{host_column}`").alias("host"),
        whole_text(text_column).alias("text"),
        *carried,
    )
    split = rows.select(
        "*",
        F.filter(F.split("text", GAP), lambda x: x != "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("raw"),
        F.filter(_plain_lines(F.col("text")), lambda x: x != "").alias("plain"),
    )
    windows = split.select(
        "*",
        F.when(
            F.size("words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)),
                lambda i: F.xxhash64(F.slice(F.col("words"), i, WINDOW)),
            ),
        )
        .otherwise(F.array().cast("array<long>"))
        .alias("windows"),
    )
    return windows.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("digest"),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("windows")).cast("long").alias("n_repeat_words"),
        F.transform(
            "plain", lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words"))
        ).alias("lines"),
        *(["row"] if carry_row else []),
    )


def _key(*columns: str) -> Column:
    """One number for a host, null too, and the other columns."""
    host, *others = columns
    return F.xxhash64(F.col(host).isNull(), F.coalesce(F.col(host).cast("string"), F.lit("")), *others)


def _shingles(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words, each once, with ``n - 1`` blanks at both ends so that every word is in ``n``."""
    edge = F.array_repeat(F.lit(""), n - 1)
    padded = F.concat(edge, words, edge)
    places = F.sequence(F.lit(1), F.size(words) + (n - 1))
    every = _let(padded, lambda w: F.transform(places, lambda i: F.xxhash64(F.slice(w, i, n))))
    return F.when(F.size(words) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<long>"))


def _shingled(text: Column) -> Column:
    """What ``_near`` compares of a text: its runs of 8 and of 2 words."""
    words = F.filter(F.split(text, GAP), lambda x: x != "")
    return _let(words, lambda w: F.struct(_shingles(w, WINDOW).alias("windows"), _shingles(w, 2).alias("pairs")))


def _near(a: Column, b: Column) -> Column:
    """Whether two texts are copies but for scattered words.

    A changed word spoils eight windows and two pairs of words, a passage of ``m`` own words ``m + 7`` and ``m + 1``.
    With two windows for each five pairs or more, what differs is three words at a place on average, in either text.
    """

    def scattered(x: Column, y: Column) -> Column:
        windows = F.size(F.array_except(x["windows"], y["windows"]))
        pairs = F.size(F.array_except(x["pairs"], y["pairs"]))
        return windows * 2 >= pairs * 5

    return scattered(a, b) & scattered(b, a)


def _of_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``own`` and ``text`` of the texts with these keys; a list of checked size goes to the texts, not they to it."""
    keys = materialize(keys.select("own").distinct(), "text-keys")
    if keys.count() <= MOST_KEYS:
        keys = F.broadcast(keys)
    return texts.join(keys, "own", "left_semi").groupBy("own").agg(F.any_value("text").alias("text"))


def _counted_texts(members: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """For every line (``at``) the texts that count, as far as ``most`` + 1: keys in ``counted``.

    ``members`` are a few texts of each line (``own``) by ``rank``: those that counted in earlier rounds, then others.
    """
    held = members.join(_of_keys(texts, members).select("own", _shingled(F.col("text")).alias("parts")), "own")
    lists = held.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("rank", "own", "parts"))).alias("texts"))

    def further(counted: Column, text: Column) -> Column:
        known = F.exists(counted, lambda c: _near(c["parts"], text["parts"]))
        return F.when((F.size(counted) > most) | known, counted).otherwise(F.concat(counted, F.array(text)))

    counted = F.aggregate("texts", F.slice("texts", 1, 0), further)
    return lists.select("at", F.transform(counted, lambda c: c["own"]).alias("counted"))


def _copies(rows: DataFrame, leaders: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows (``at``, ``own``) whose text is a copy of one of the ``leaders`` (``at``, ``lead``) of its line.

    A text meets each of its leaders once, on however many lines; texts are dealt out by their own key, and the few
    leaders come to them.
    """
    met = materialize(rows.join(leaders, "at").select("own", "lead").distinct(), "copy-pairs")
    parts = _of_keys(texts, met).select("own", _shingled(F.col("text")).alias("parts"))
    leading = materialize(
        _of_keys(texts, met.select(F.col("lead").alias("own"))).select(
            F.col("own").alias("lead"), _shingled(F.col("text")).alias("lead_parts")
        ),
        "leaders",
    )
    near = met.join(parts, "own").join(leading, "lead").filter(_near(F.col("parts"), F.col("lead_parts")))
    near = materialize(near.select("own", "lead"), "copies")
    return rows.join(leaders, "at").join(near, ["own", "lead"], "left_semi").select("at", "own").distinct()


def _lines_of_different_texts(rows: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """``at`` and ``documents`` of the lines that more than ``most`` different texts have.

    ``rows`` has the texts (``own``, by ``digest``) of each line, ``texts`` has ``own`` and ``text``. Every round goes
    through the next few texts of each line that is not decided, and leaves out the copies of those that counted. A
    line has at most ``most`` texts that count in a further round, so a round moves a bounded number of texts for each
    line, and each of the others once.
    """
    order = Window.partitionBy("at").orderBy("digest", "own")
    leaders, out = None, None
    while True:
        ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= BATCH)
        batch = materialize(ranked.select("at", "own", "rank"), "line-batch")
        members = batch
        if leaders is not None:
            members = batch.union(leaders.select("at", F.col("lead").alias("own"), F.lit(0).alias("rank")))
        counted = materialize(_counted_texts(members, texts, most), "counted-texts")
        over = counted.filter(F.size("counted") > most).select("at", F.size("counted").cast("long").alias("documents"))
        out = over if out is None else materialize(out.union(over), "lines")
        leaders = counted.filter(F.size("counted") <= most).select("at", F.explode("counted").alias("lead"))
        rows = rows.join(leaders.select("at").distinct(), "at", "left_semi").join(batch, ["at", "own"], "left_anti")
        rows = materialize(rows, "line-texts")
        if rows.isEmpty():
            return out
        rows = materialize(rows.join(_copies(rows, leaders, texts), ["at", "own"], "left_anti"), "line-texts")
        if rows.isEmpty():
            return out


def removable_lines(measured: DataFrame, texts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``host``, ``line``, ``documents``: the lines too frequent on their host.

    Occurrences are made distinct per (host, line, text) first and counted by (host, line) from partial counts, so a
    line of a third of all documents is no hot task. Only the texts (``host``, ``text``) of lines that enough texts
    have are compared. ``documents`` is the number that was counted when the line was known to be over its limit.
    """
    found = measured.select("host", "digest", F.explode(F.array_distinct("lines.line")).alias("line")).distinct()
    counted = found.groupBy("host", "line").agg(F.count("*").alias("texts")).filter(F.col("texts") > limits.line_documents)
    counted = materialize(counted.select("host", "line", _key("host", "line").alias("at")), "line-counts")
    rows = found.select(_key("host", "line").alias("at"), _key("host", "digest").alias("own"), "digest")
    rows = materialize(rows.join(counted.select("at"), "at"), "line-texts")
    keyed = texts.withColumn("digest", F.xxhash64("text")).select(_key("host", "digest").alias("own"), "text")
    over = _lines_of_different_texts(rows, keyed, limits.line_documents)
    return counted.join(over, "at").select("host", "line", "documents")


def _with_hits(rows: DataFrame, lines: Column, frequent: DataFrame, name: str, limits: Limits) -> DataFrame:
    """``rows`` (with host and the key doc_id, digest) plus an array of the removable lines each of them has."""
    if frequent.count() <= limits.broadcast_lines:
        by_host = frequent.groupBy(F.col("host").alias("_h")).agg(F.collect_list("line").alias("_frequent"))
        joined = rows.join(F.broadcast(by_host), F.col("host").eqNullSafe(F.col("_h")), "left")
        hits = F.array_intersect(lines, F.coalesce("_frequent", F.array().cast("array<long>")))
        return joined.withColumn(name, hits).drop("_h", "_frequent")
    found = (
        rows.select("doc_id", "digest", "host", F.explode(F.array_distinct(lines)).alias("line"))
        .alias("r")
        .join(
            frequent.alias("f"),
            (F.col("r.line") == F.col("f.line")) & F.col("r.host").eqNullSafe(F.col("f.host")),
            "left_semi",
        )
        .groupBy(F.col("doc_id").alias("_i"), F.col("digest").alias("_d"), F.col("host").alias("_h"))
        .agg(F.collect_set("line").alias(name))
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("_i"))
        & (F.col("digest") == F.col("_d"))
        & F.col("host").eqNullSafe(F.col("_h"))
    )
    return rows.join(found, same, "left").drop("_i", "_d", "_h")


def _base_failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * limits.max_repeat_percent
    )


def judge(measured: DataFrame, frequent: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``measured`` with ``hits`` (removable lines of the document), ``removed_words``, ``base_failed``, ``kept``."""
    hits = _with_hits(measured, F.col("lines.line"), frequent, "hits", limits)
    removed = F.aggregate(
        F.filter("lines", lambda x: F.array_contains("hits", x["line"])),
        F.lit(0),
        lambda a, x: a + x["words"],
    )
    left = F.col("n_words") - F.col("removed_words")
    return (
        hits.withColumn("base_failed", _base_failed(limits))
        .withColumn("removed_words", F.when(F.size("hits") > 0, removed).otherwise(0).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & (left >= F.col("n_words") * limits.keep_share))
    )


def _texts(docs: DataFrame, text_column: str, host_column: str) -> DataFrame:
    return docs.select(F.col(f"`{host_column}`").alias("host"), whole_text(text_column).alias("text"))


def line_quality(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
    limits: Limits = Limits(),
) -> DataFrame:
    """One verdict per document, see ``measure`` and ``judge``; an empty table gives an empty result.

    Repeated rows are judged each. Columns of other names are not read.
    """
    measured = materialize(measure(docs, id_column, text_column, host_column), "line-quality")
    frequent = materialize(removable_lines(measured, _texts(docs, text_column, host_column), limits), "lines")
    return judge(measured, frequent, limits).drop("lines", "hits", "digest")


def _without(text: Column, hits: Column) -> Column:
    """The text without the lines whose normalised form is among ``hits``."""

    def rest(hashes: Column) -> Column:
        lines = F.filter(
            F.split(text, "\n", -1), lambda x, i: ~F.coalesce(F.array_contains(hits, F.get(hashes, i)), F.lit(False))
        )
        return F.array_join(lines, "\n")

    hashes = F.transform(_plain_lines(text), lambda x: F.when(x != "", F.xxhash64(x)))
    return _let(hashes, rest)


def clean(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
    length_column: str | None = None, limits: Limits = Limits(),
) -> DataFrame:
    """The kept documents with their removable lines taken out, in the columns of ``docs``.

    Texts without such a line come through unchanged. ``length_column`` (characters of the text) is renewed with the
    text if named. The texts are measured again rather than written out or joined with their verdicts.
    """
    measured = materialize(measure(docs, id_column, text_column, host_column), "line-quality")
    frequent = materialize(removable_lines(measured, _texts(docs, text_column, host_column), limits), "lines")
    judged = judge(measure(docs, id_column, text_column, host_column, carry_row=True), frequent, limits)
    text = F.col("row")[text_column]
    new = F.when(F.size("hits") > 0, _without(text, F.col("hits"))).otherwise(text)
    columns = {c: F.col("row")[c] for c in docs.columns}
    columns[text_column] = new
    if length_column:
        length = F.col("row")[length_column]
        renewed = F.char_length(new).cast(docs.schema[length_column].dataType)
        columns[length_column] = F.when(F.size("hits") > 0, renewed).otherwise(length)
    out = F.struct(*[value.alias(c) for c, value in columns.items()])
    # Not a filter: pushed down, it would carry the hashing of all windows into the lambda over them.
    return judged.select(F.explode(F.when(F.col("kept"), F.array(out))).alias("row")).select("row.*")
