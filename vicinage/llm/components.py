"""Connected components by contraction, for links that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinage.session import cut


def _hook(links: DataFrame) -> DataFrame:
    """(node, parent): the smallest of each node and its neighbours."""
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
                                          F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("l"))
    return both.groupBy(F.col("l.node").alias("node")).agg(F.min("l.other").alias("other")).select(
        "node", F.least("node", "other").alias("parent"))


def _jump(tree: DataFrame) -> DataFrame:
    """Every node points to its parent's parent. Parents are nodes of the same links, so none is missing."""
    up = tree.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    return tree.join(up, tree["parent"] == up["_n"]).select("node", F.col("_p").alias("parent"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node that can be reached.

    Each round hooks a node to its smallest neighbour, shortens the paths, and contracts the links to their roots, so
    the links shrink by a factor and the number of rounds is logarithmic. A star of any size contracts in one round:
    its arms are pre-aggregated before the shuffle, and the joins' large side can be split. Self-links and repeats are
    allowed; nodes are never null. No links: an empty result.
    """
    links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while True:
        tree = cut(_jump(_jump(_hook(links))))
        if found is None:
            found = tree
        else:
            up = tree.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
            found = cut(found.join(up, found["parent"] == up["_n"], "left").select(
                "node", F.coalesce("_p", "parent").alias("parent")))
        a = tree.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        b = tree.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        links = cut(links.join(a, "a").join(b, "b").where("_a <> _b").select(
            F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        if links.isEmpty():
            return found.select("node", F.col("parent").alias("component"))
