"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqengine.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node with a link; ``root`` is the smallest node that can be reached.

    ``links`` has the columns ``a`` and ``b`` of one orderable type. In every round each node takes the smallest label
    of its neighbours, then the label of its label, so the number of rounds follows the logarithm of the longest path.
    Minima are taken from partial minima per task, so a node with very many links is no hot task. Every round is
    written to the shared folder: a lost executor costs no earlier round.
    """
    both = materialize(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels"
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        lower = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("root").alias("jump"))
        following = materialize(
            lower.join(jump, "lower").select("node", F.least("lower", "jump").alias("new"), "root"), "labels"
        )
        changed = following.filter("new <> root").limit(1).count()
        labels = following.select("node", F.col("new").alias("root"))
        if not changed:
            return labels
