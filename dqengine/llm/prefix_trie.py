"""A trie of conversation prefixes, measured over its Euler tour.

Each turn has two 64-bit hashes of its depth and content; a prefix is named by the exclusive or of those of its turns,
so the names of all prefixes are running values, and the parent's name is one step back. The tour enters and leaves
every node: the arc into a node leads to its first child, or out again; the arc out of a node leads to its next
sibling, or out of its parent. The rank of an arc in that list is its position; running sums over positions, taken at
both arcs of a node, give the totals of its subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqengine.llm.common import ship, whole_text, word_count
from dqengine.llm.sequences import list_ranks, numbered, placed, running, with_parts
from dqengine.session import materialize

#: Turns of a conversation that one window holds.
TURN_BITS = 12
#: Ids of conversations that are joined to one text before they are hashed.
ID_BITS = 13


def rebuilt_turns(
    conversations: DataFrame,
    block: int = 20,
    most_shared: int = 4,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Turns (``conv``, ``depth`` from 1, ``digest``, ``words``) and conversations (``conv``, ``depth`` in all).

    Conversation c starts with the first h turns of conversation c - c % block (all, if that has fewer; none, if it
    does not exist) and goes on with its own turns after its first h, where h is crc32 of the decimal id modulo
    ``most_shared``. The remainder has the sign of c. Turns are ordered by turn number, null first; turns of one
    number by role, then by digest. Null roles and texts are empty. Rows without an id belong to no conversation.
    """
    role, text = whole_text(role_column), whole_text(text_column)
    turns = conversations.filter(F.col(f"`{id_column}`").isNotNull()).select(
        F.col(f"`{id_column}`").cast("long").alias("conv"),
        F.col(f"`{turn_column}`").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        word_count(F.col(f"`{text_column}`").cast("string")).alias("words"),
    )
    table, parts = placed(turns, ["conv"], ["turn", "role", "digest"], "turns")
    convs = parts.groupBy("conv").agg(F.sum("n").alias("n")).select(
        "conv",
        "n",
        (F.col("conv") - F.col("conv") % block).alias("donor"),
        F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most_shared)).alias("h"),
    )
    donors = convs.select(F.col("conv").alias("donor"), F.col("n").alias("donor_n"))
    convs = convs.join(donors, "donor", "left").withColumn("k", F.least("h", F.coalesce("donor_n", F.lit(0))))
    convs = materialize(convs.withColumn("depth", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")

    known = parts.join(convs.select("conv", "h", "k"), "conv")
    placing = with_parts(table, known, ["conv"])
    own = placing.filter("place >= h").selectExpr("conv", "k + place - h + 1 as depth", "digest", "words")
    heads = placing.filter(F.col("place") < most_shared - 1).selectExpr("conv as donor", "place", "digest", "words")
    shared = convs.filter("k > 0").select("conv", "donor", "k").join(heads, "donor").filter("place < k")
    turns = own.union(shared.selectExpr("conv", "place + 1 as depth", "digest", "words"))
    return materialize(turns, "rebuilt"), convs.select("conv", "depth")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per different prefix of the conversations, the empty one included.

    ``turns`` has ``conv``, ``depth`` (1, 2, … in each conversation), ``digest`` (of the content) and ``words``;
    ``conversations`` has every ``conv`` with its ``depth``. Returns ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. No
    conversations, no nodes. Prefixes are compared by 128 bits of hash over SHA-256 digests.
    """
    prefixes = materialize(_prefixes(turns), "prefixes")
    members = F.count("*").alias("n_convs")
    found = prefixes.groupBy("a", "b").agg(
        F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), members,
        F.min("words").alias("words"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
    )
    none = [F.lit(0).cast("long").alias(c) for c in ("a", "b")]
    root = conversations.groupBy(*none).agg(
        F.min("conv").alias("conv_id"), F.lit(0).cast("long").alias("depth"), members,
        F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"),
    )
    # A child follows its parent by smallest member and depth, so neighbours in the tour mostly have near numbers.
    nodes = materialize(numbered(found.union(root), [], ["conv_id", "depth"], "nodes").withColumnRenamed("place", "id"), "nodes")
    above = nodes.selectExpr("a as pa", "b as pb", "id as parent", "conv_id as parent_conv_id")
    nodes = materialize(nodes.join(above, ["pa", "pb"], "left"), "nodes")
    totals = _subtrees(nodes)
    return (
        nodes.join(totals, "id")
        .join(_ends(prefixes, conversations), ["a", "b"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def _mark(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "depth", "digest")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with the name of the prefix it ends (``a``, ``b``) and of the one before it (``pa``, ``pb``)."""
    marked = turns.select(
        "conv", "depth", "words", _mark(1).alias("x"), _mark(2).alias("y"),
        F.shiftright("depth", TURN_BITS).alias("chunk"),
    )
    upto = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = marked.select("*", F.bit_xor("x").over(upto).alias("a"), F.bit_xor("y").over(upto).alias("b"))
    # Longer conversations: what all earlier chunks add up to.
    long = turns.filter(F.col("depth") >= 1 << TURN_BITS).select("conv").distinct()
    chunks = marked.join(long, "conv", "left_semi").groupBy("conv", "chunk").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select("conv", "chunk", F.bit_xor("x").over(earlier).alias("bx"), F.bit_xor("y").over(earlier).alias("by"))
    whole = local.join(before.filter("chunk > 0"), ["conv", "chunk"], "left").withColumns(
        {"a": F.col("a").bitwiseXOR(F.coalesce("bx", F.lit(0))), "b": F.col("b").bitwiseXOR(F.coalesce("by", F.lit(0)))}
    )
    back = [F.col(c).bitwiseXOR(F.col(x)).alias(f"p{c}") for c, x in (("a", "x"), ("b", "y"))]
    return whole.select("conv", "depth", "words", "a", "b", *back)


def _subtrees(nodes: DataFrame) -> DataFrame:
    """``id``, ``n_children``, ``n_leaves`` and ``saved_tokens`` of every node, from the positions of its arcs."""
    families = nodes.filter("parent is not null")
    children = families.groupBy("parent").agg(F.count("*").alias("n_children"), F.min("id").alias("child"))
    # The next sibling stands on the next row of all nodes in the order of their parents.
    rows = materialize(numbered(families.select("parent", "id"), [], ["parent", "id"], "siblings"), "siblings")
    after = rows.selectExpr("place - 1 as place", "parent as of", "id as sibling")
    siblings = rows.join(after, "place").filter("parent = of").select("id", "sibling")
    nodes = nodes.join(siblings, "id", "left").join(children.withColumnRenamed("parent", "id"), "id", "left")
    nodes = materialize(
        nodes.select(
            "id", "parent", "sibling", "child",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        ),
        "family",
    )
    # Arc 2i enters node i and arc 2i + 1 leaves it.
    into = F.struct(
        F.expr("2 * id").alias("item"),
        F.coalesce(F.expr("2 * child"), F.expr("2 * id + 1")).alias("next"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"),
        F.col("saved"),
    )
    out = F.struct(
        F.expr("2 * id + 1").alias("item"),
        F.coalesce(F.expr("2 * sibling"), F.expr("2 * parent + 1"), F.lit(-1)).alias("next"),
        F.lit(0).cast("long").alias("leaf"),
        F.lit(0).cast("long").alias("saved"),
    )
    arcs = materialize(nodes.select(F.explode(F.array(into, out)).alias("arc")).select("arc.*"), "arcs")
    hops = F.when(F.col("next") < 0, 0).otherwise(1).cast("long").alias("hops")
    ranks = list_ranks(arcs.select("item", F.col("next").cast("long"), hops), 0)
    last = arcs.count() - 1
    tour = arcs.join(ranks, "item").select("item", "leaf", "saved", (F.lit(last) - F.col("rank")).alias("position"))
    sums = running(materialize(tour, "tour"), "position", ["leaf", "saved"])
    entering = F.col("item") % 2 == 0

    def inside(value: str) -> Column:
        """The sum up to the arc out, less the sum before the arc in."""
        return F.sum(F.when(entering, F.col(value) - F.col(f"{value}_upto")).otherwise(F.col(f"{value}_upto")))

    totals = sums.groupBy(F.shiftright("item", 1).alias("id")).agg(
        inside("leaf").alias("n_leaves"), inside("saved").alias("saved_tokens")
    )
    return nodes.select("id", "n_children").join(totals, "id")


def _ends(prefixes: DataFrame, conversations: DataFrame) -> DataFrame:
    """For each node at which conversations end, the SHA-256 of their ascending decimal ids, with commas between.

    Ids are numbered within their node over all tasks and joined to texts of bounded length there; the hash of a node
    then reads its texts one after the other and holds none of them.
    """
    ship(prefixes.sparkSession)
    ended = prefixes.join(conversations, ["conv", "depth"]).select("a", "b", "conv")
    none = [F.lit(0).cast("long").alias(c) for c in ("a", "b")]
    ended = ended.union(conversations.filter("depth = 0").select(*none, "conv"))
    places = numbered(ended, ["a", "b"], ["conv"], "ends")
    texts = places.groupBy("a", "b", F.shiftright("place", ID_BITS).alias("number")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("text")
    )
    ordered = texts.repartition("a", "b").sortWithinPartitions("a", "b", "number")
    return ordered.mapInArrow(_hash_texts, "a long, b long, ends_sha256 string")


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest = None, None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if (row["a"], row["b"]) != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (row["a"], row["b"]), hashlib.sha256(row["text"].encode())
            else:
                digest.update(b"," + row["text"].encode())
        yield _digests(done)
    if node is not None:
        yield _digests([(*node, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    a, b, digests = (list(c) for c in zip(*rows)) if rows else ([], [], [])
    return pa.record_batch(
        {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "ends_sha256": pa.array(digests, pa.string())}
    )
