"""Connected components of a link table, as joins and aggregates.

Each round every node hooks to its smallest linked neighbour, the resulting
trees are flattened by pointer jumping, and the links are rewritten to tree
roots. At least half of the roots that still have a link vanish per round.
Tables between steps are written to the shared folder, so both sides of each
join are plain exchanges and adaptive execution can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame | None:
    """``(node, root)`` of every linked node; ``root`` is the smallest node
    it reaches. None if there is no link. Intermediate tables and the result
    belong to ``scratch``."""
    written = scratch.written
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .where(F.col("u") != F.col("v")).distinct(), "links")
    labels = None
    while not edges.isEmpty():
        tree = written(edges.groupBy("u").agg(F.min("v").alias("p")), "tree")
        while True:                                   # p(u) <- p(p(u)) until every parent is a root
            up = tree.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
            jumped = written(tree.join(up, tree["p"] == up["_u"], "left")
                             .select("u", F.coalesce("_p", "p").alias("p"), F.col("_p").isNotNull().alias("moved")), "tree")
            tree = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
            labels = nodes.withColumn("root", F.col("node"))
        up = tree.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
        labels = written(labels.join(up, labels["root"] == up["_u"], "left")
                         .select("node", F.coalesce("_p", "root").alias("root")), "labels")
        for end in ("u", "v"):
            edges = edges.join(up, edges[end] == up["_u"], "left").withColumn(end, F.coalesce("_p", end)).drop("_u", "_p")
        edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .where(F.col("u") != F.col("v")).distinct(), "links")
    return labels
