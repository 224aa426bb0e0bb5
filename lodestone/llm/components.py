"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.materialize import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` for each node of ``edges(a, b)``: ``root`` is the smallest node that ``node`` can reach.

    Large-star and small-star steps in turn: every node's neighbours are hung on its smallest neighbour, which halves
    the depth of trees about each time. A step is a minimum by key (summed up before the shuffle) and a join that adaptive execution can
    split where a node has very many neighbours. Each round's edges, at most as many as at the start, are written to the shared
    folder. Null ends are ignored, and so are loops; an empty table gives no rows.
    """
    # (child, parent) with parent < child
    tree = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    tree = tree.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct()
    tree = materialize(tree, "components")
    before = None
    while True:
        state = tree.agg(F.count(F.lit(1)), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return tree.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(
                tree.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct()
            )
        before = state
        both = tree.select(F.col("child").alias("u"), F.col("parent").alias("v")).unionByName(
            tree.select(F.col("parent").alias("u"), F.col("child").alias("v"))
        )
        # written, so that the join is one of two plain shuffles, which adaptive execution can split at a hot node
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "of")
        least = materialize(least, "components")
        large = both.join(least, F.col("u") == F.col("of")).filter("v > u").select(F.col("v").alias("child"), F.col("m").alias("parent"))
        large = large.distinct()
        large = materialize(large, "components")
        least = large.groupBy("child").agg(F.min("parent").alias("m")).withColumnRenamed("child", "of")
        small = large.join(least, F.col("child") == F.col("of"))
        hung = small.select(F.col("parent").alias("child"), F.col("m").alias("parent")).filter("child != parent")
        kept = small.select("child", F.col("m").alias("parent"))
        tree = materialize(hung.unionByName(kept).distinct(), "components")
