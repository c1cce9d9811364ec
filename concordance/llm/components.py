"""Connected components of a graph in DataFrames, by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: longs); root is the least node reachable.

    Each round every node is contracted into the neighbour (or itself) whose hash,
    another one each round, is least; links between contracted nodes remain.  Whatever
    the graph, and for a long chain or a star alike, a constant part of the nodes goes in
    each round, so rounds grow with the logarithm of the nodes.  A node's links are
    only reduced to a minimum, by partial aggregation, and never gathered; joins are on
    single nodes, so a hub's rows can be split.  Each round is written to the shared
    folder.  Repeated links, links to itself and nulls do no harm.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = staged(links, "links")
    labels = None
    for i in range(rounds):
        if links.isEmpty():
            break
        rank = lambda x: F.struct(F.xxhash64(x, F.lit(i)).alias("h"), F.col(x).alias("id"))  # noqa: B023, E731
        both = links.select(F.col("a").alias("node"), rank("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), rank("a").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("to"))
        own = rank("node")
        step = staged(least.select("node", F.least(own, F.col("to"))["id"].alias("root")), "step")
        left = links.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        links = staged(left.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        if labels is None:
            labels = step
        else:
            on = step.select(F.col("node").alias("root"), F.col("root").alias("new"))
            labels = staged(labels.join(on, "root", "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
    else:
        raise RuntimeError("too few rounds")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = labels.groupBy("root").agg(F.least(F.min("node"), F.min("root")).alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))
