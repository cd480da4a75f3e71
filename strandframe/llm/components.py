"""Connected components of a table of links, by contraction of picked neighbours; nothing comes to the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the smallest node reachable.

    Every node picks its smallest neighbour. Picks make cycles of two only, and each tree of picks becomes one node, named by
    the smaller node of its cycle, so that at least half of the nodes with links go in a round: the rounds are logarithmic in
    the size of a component, whatever its shape, and the loop ends when no link is left. The smallest node of a component
    and its pick pick each other, so it names its tree in every round and the component in the end.
    """
    edges = scratch.put(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = None
    while True:
        picks = edges.groupBy("a").agg(F.min("b").alias("up"))
        back = picks.select(F.col("a").alias("via"), F.col("up").alias("back"))
        root = (F.col("back") == F.col("a")) & (F.col("a") < F.col("up"))
        trees = _roots(scratch, scratch.put(picks.join(back, F.col("up") == F.col("via")).select(F.col("a").alias("node"), F.when(root, F.col("a")).otherwise(F.col("up")).alias("label"))))
        near, far = (trees.select(F.col("node").alias(n), F.col("label").alias(x)) for n, x in (("na", "la"), ("nb", "lb")))
        rest = scratch.put(edges.join(near, F.col("a") == F.col("na")).join(far, F.col("b") == F.col("nb")).filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        scratch.drop(edges)
        edges = rest
        if labels is None:
            labels = trees
        else:
            new = scratch.put(labels.join(near, F.col("label") == F.col("na"), "left").select("node", F.coalesce("la", "label").alias("label")))
            scratch.drop(labels, trees)
            labels = new
        if not edges.limit(1).count():
            scratch.drop(edges)
            return labels


def _roots(scratch: Scratch, trees: DataFrame) -> DataFrame:
    """(node, label) with the root of its tree as every node's label, by pointer jumping; roots label themselves."""
    while True:
        far = trees.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        new = scratch.put(trees.join(far, F.col("label") == F.col("via")).select("node", F.col("label").alias("old"), F.col("beyond").alias("label")))
        changed = new.filter("old <> label").limit(1).count()
        scratch.drop(trees)
        trees = new.select("node", "label")
        trees._scratch = new._scratch
        if not changed:
            return trees
