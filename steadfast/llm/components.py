"""Connected components of a graph given by its edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadfast.llm.common import dealt, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node with an edge (a, b), the smallest node it is connected with.

    Each round offers the smaller of two linked roots to the larger one, then lets every node jump
    to its root's root; it ends when no link joins different roots. Only (node, root) pairs and
    edges are joined, by keys that Spark may split, and minima are combined before the shuffle, so
    a node with very many links is no bottleneck.
    """
    edges = edges.where(F.col("a") != F.col("b")).select("a", "b")
    roots = saved(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                  .select("node", F.col("node").alias("root")), "roots")
    while True:
        ends = (edges.join(dealt(roots.select(F.col("node").alias("a"), F.col("root").alias("x"))), "a")
                .join(dealt(roots.select(F.col("node").alias("b"), F.col("root").alias("y"))), "b")
                .where(F.col("x") != F.col("y")))
        offers = saved(ends.groupBy(F.greatest("x", "y").alias("root")).agg(F.min(F.least("x", "y")).alias("lower")), "offers")
        if not offers.take(1):
            return roots
        hooked = saved(roots.join(dealt(offers), "root", "left").select("node", F.coalesce("lower", "root").alias("root")), "roots")
        roots = _flat(hooked)


def _flat(roots: DataFrame) -> DataFrame:
    """Pointer jumping until every root is its own root."""
    while True:
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = saved(roots.join(dealt(above), "root").select("node", F.col("next").alias("root"),
                                                        (F.col("next") != F.col("root")).alias("moved")), "roots")
        if not jumped.where("moved").take(1):
            return jumped.select("node", "root")
        roots = jumped.select("node", "root")
