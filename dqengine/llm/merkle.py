"""A Merkle manifest of a table: a binary hash tree per group, and one over the groups' roots.

Rows are numbered within their group over all tasks. A window then climbs ``LEVELS`` levels inside runs of
2 ** LEVELS rows: on each level the nodes stand on the first rows of their leaves, lag and lead columns at that fixed
offset give every node its sibling, and the first child's row hashes the parent. What is left of a run is one row of
the next climb. No window holds a whole group, so its size does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqengine.llm.sequences import numbered
from dqengine.session import materialize

LEVELS = 10
#: The sibling of a node stands to its left or right, or the node is alone in its run.
LEFT, RIGHT, ALONE = -1, 1, 0


def row_hash(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields: ``-`` if null, else number of UTF-8 bytes, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _together(*digests: Column) -> Column:
    return F.sha2(F.concat(*digests).cast("binary"), 256)


def manifest(leaves: DataFrame, group: str, order: str, leaf: str = "leaf") -> DataFrame:
    """The rows of ``leaves`` with ``subroot`` of their group, ``root`` of the table, and ``siblings`` up to it.

    Leaves ascend by ``order`` (null first) in their group, those of one value by digest; groups ascend, null first,
    strings by their bytes. While several nodes are left, every two consecutive ones become the hash of both digests,
    and a single last one the hash of its own; a group's last node is its ``subroot``, and the subroots make the root
    in the same way. ``siblings`` lists ``side`` (LEFT, RIGHT or ALONE) and ``digest`` (bytes, null if alone) from the
    leaf up. Other columns must not be named group, place, n, digest, siblings, subroot, root or upper. No rows, no result.
    """
    rows = leaves.withColumnsRenamed({group: "group"}).withColumn("digest", F.col(leaf))
    places = numbered(rows, ["group"], [order, "digest"], "leaves")
    sizes = places.groupBy(F.col("group").alias("g")).agg((F.max("place") + 1).alias("n"))
    places = places.join(sizes, F.col("group").eqNullSafe(F.col("g"))).drop("g")
    tables = _climb(places, "tree")
    # The one node left of each group is a leaf of the tree over the groups.
    tops = tables[-1].selectExpr("group as of", "digest as subroot", "'all' as group", "digest")
    tops = numbered(tops, ["group"], ["of"], "subroots")
    over = _climb(tops.withColumn("n", F.lit(tops.count())), "groups")
    top = over[-1].first()
    root = F.lit(top["digest"] if top else None).cast("string").alias("root")
    above = _joined(over[:-1], ["of", "subroot"]).select(F.col("of").alias("group"), "subroot", F.col("siblings").alias("upper"))
    found = _joined(tables[:-1], [c for c in leaves.columns if c != group])
    other = above.withColumnRenamed("group", "g")
    whole = found.join(other, found["group"].eqNullSafe(F.col("g")))
    return whole.select(
        *[F.col("group").alias(group) if c == group else F.col(c) for c in leaves.columns],
        "subroot", root, F.concat("siblings", "upper").alias("siblings"),
    )


def _climb(nodes: DataFrame, label: str) -> list[DataFrame]:
    """Written tables of each climb, with the siblings of its rows; the last one holds the top of each group."""
    tables = []
    while True:
        table = materialize(_run_tops(nodes), label)
        tables.append(table)
        nodes = table.filter("top is not null").select(
            "group", F.shiftright("place", LEVELS).alias("place"), _upper("n").alias("n"), F.col("top").alias("digest")
        )
        if not nodes.filter("n > 1").limit(1).count():
            return [*tables, nodes]


def _upper(n: str) -> Column:
    """Number of nodes after one climb."""
    return F.shiftright(F.col(n) + ((1 << LEVELS) - 1), LEVELS)


def _run_tops(nodes: DataFrame) -> DataFrame:
    """Rows with ``siblings`` inside their run; the first row of a run has its ``top``."""
    run = Window.partitionBy("group", F.shiftright("place", LEVELS)).orderBy("place")
    upto = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = [c for c in nodes.columns]
    nodes = nodes.withColumn("node", F.col("digest"))
    for level in range(LEVELS):
        offset = 1 << level
        # Masks: nodes stand on every offset-th row, slot 0 has its sibling after it, and one node is the end.
        slot = F.shiftright("place", level).bitwiseAND(F.lit(1))
        several = F.col("n") > offset
        before, after = F.lag("node", offset).over(run), F.lead("node", offset).over(run)
        sibling = F.when(slot == 0, after).otherwise(before)
        side = F.when(sibling.isNull(), ALONE).when(slot == 0, RIGHT).otherwise(LEFT)
        stands = F.col("node").isNotNull() & several
        nodes = nodes.withColumn(
            f"s{level}", F.when(stands, F.struct(side.cast("byte").alias("side"), F.unhex(sibling).alias("digest")))
        )
        parent = _together(F.col("node"), F.coalesce(F.lower(F.hex(f"s{level}.digest")), F.lit("")))
        nodes = nodes.withColumn("node", F.when(~several, F.col("node")).when(slot == 0, F.when(F.col("node").isNotNull(), parent)))
        nodes = nodes.withColumn("node", F.when(F.col("place") % (2 * offset) == 0, F.col("node")))
    # Between two nodes of a level stand only leaves of the first of them.
    own = [F.when(F.col("n") > (1 << i), F.last(f"s{i}", ignorenulls=True).over(upto)) for i in range(LEVELS)]
    return nodes.select(
        *held, F.filter(F.array(*own), lambda s: s.isNotNull()).alias("siblings"), F.col("node").alias("top")
    )


def _joined(tables: list[DataFrame], columns: list[str]) -> DataFrame:
    """The rows of the first table with their siblings of all climbs."""
    above = None
    for table in reversed(tables):
        names = ["group", "place", "siblings", *(columns if table is tables[0] else [])]
        if above is not None:
            upper = above.select(F.col("group").alias("g"), F.col("place").alias("p"), F.col("siblings").alias("more"))
            here = F.col("group").eqNullSafe(F.col("g")) & (F.shiftright("place", LEVELS) == F.col("p"))
            table = table.join(upper, here).withColumn("siblings", F.concat("siblings", "more"))
        above = table.select(*names)
    return above


def proof_hash(siblings: Column) -> Column:
    """Hash of the digests of all siblings, from the leaf up."""
    others = F.filter(siblings, lambda s: s["digest"].isNotNull())
    return _together(F.array_join(F.transform(others, lambda s: F.lower(F.hex(s["digest"]))), ""))


def fold(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def up(node: Column, sibling: Column) -> Column:
        other = F.lower(F.hex(sibling["digest"]))
        left, right = F.when(sibling["side"] == LEFT, other).otherwise(""), F.when(sibling["side"] == RIGHT, other).otherwise("")
        return _together(left, node, right)

    return F.aggregate(siblings, leaf, up)


def verified_documents(
    docs: DataFrame,
    every: int = 7,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_column: str = "doc_id",
    group_column: str = "lang",
    changed_column: str = "n_chars",
) -> DataFrame:
    """Manifest of documents, and its proofs held against rows of which some were changed.

    Where ``every`` divides the unsigned CRC-32 of the decimal id, ``changed_column`` is one more in the row that is
    verified (null stays null, and a null id is never changed). Returns the id, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256``, ``folded_root`` and ``verified``; equal rows are a row each, further columns are left out.
    """
    col = {f: F.col(f"`{f}`") for f in fields}
    more = F.coalesce((F.crc32(col[id_column].cast("string")) % every) == 0, F.lit(False))
    changed = {**col, changed_column: col[changed_column].cast("decimal(38,0)") + 1}
    leaves = docs.select(
        col[id_column].alias("id"),
        F.col(f"`{group_column}`").alias("part_of"),
        row_hash(*col.values()).alias("leaf"),
        F.when(more, row_hash(*changed.values())).alias("tampered"),
    )
    found = manifest(leaves, "part_of", "id")
    folded = F.transform(F.array(F.coalesce("tampered", "leaf")), lambda given: fold(given, F.col("siblings")))[0]
    return found.select(
        F.col("id").alias(id_column), "leaf", "subroot", "root",
        proof_hash(F.col("siblings")).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
