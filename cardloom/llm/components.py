"""Connected components by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links (columns `a`, `b`) from each node in them.

    Each round a node points to the smallest of itself and its neighbours, pointers are followed to their ends, and
    links are drawn anew between those ends. A node that stays alone has a smaller neighbour in the next round, so at
    least half of the nodes that still have links go in every two rounds, and links only become fewer. Tables are written
    each round, so a lost executor repeats one round at most. An empty table of links gives an empty result.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.filter("a <> b").distinct(), "edges")
    labels = None
    while True:
        ends = _ends(edges.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("label")))
        if labels is None:
            labels = ends
        else:
            moved = ends.select(F.col("node").alias("label"), F.col("label").alias("end"))
            labels = written(labels.join(moved, "label", "left").select("node", F.coalesce("end", "label").alias("label")), "labels")
        begin, end = ends.select(F.col("node").alias("a"), F.col("label").alias("_a")), ends.select(F.col("node").alias("b"), F.col("label").alias("_b"))
        drawn = edges.join(begin, "a").join(end, "b").filter("_a <> _b")
        edges = written(drawn.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def _ends(pointers: DataFrame) -> DataFrame:
    """(node, label) with each label replaced by the one that points to itself; every label is a node and none is larger than its node."""
    pointers = written(pointers, "labels")
    while True:
        jump = pointers.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        after = written(pointers.join(jump, "label").select("node", F.col("jump").alias("label"), (F.col("jump") < F.col("label")).alias("moved")), "labels")
        pointers = after.select("node", "label")
        if after.filter("moved").isEmpty():
            return pointers
