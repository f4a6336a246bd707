"""Connected components by repeated least labels; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.io import cut_lineage


def thinned(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) with the same components: a node keeps the link to the least of its lesser nodes and hands the others down to that one.

    In stars that share their members, as of texts that meet in many buckets, the links left are about as many as the
    nodes. A node's lesser nodes are gathered in one row, so they should be few (a text's buckets).
    """
    way = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    held = way.groupBy("a").agg(F.collect_set("b").alias("lesser")).select("a", "lesser", F.array_min("lesser").alias("b"))
    passed = held.select(F.explode("lesser").alias("a"), "b").where("a <> b")
    return held.select("a", "b").unionAll(passed).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for links (a, b): root is the least node of the component.

    Every round takes the least label of the neighbours and then the label of that label, so a chain of
    length n needs about log n rounds. Each round is checkpointed.
    """
    both = cut_lineage(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("best"))
        less = labels.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "best").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("root").alias("far"))
        new = cut_lineage(less.join(jump, "best").select("node", F.least("best", "far").alias("new"), "root"))
        moved = new.where("new <> root").limit(1).count()
        labels = new.select("node", F.col("new").alias("root"))
        if not moved:
            return labels
