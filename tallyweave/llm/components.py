"""Connected components of a graph held in frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rounds after which the loop is taken to be broken; labels meet in about log2 of the longest path.
ROUNDS = 100


def components(edges: DataFrame, one: str = "a", other: str = "b") -> DataFrame:
    """``node, label`` of every node of the edges; the label is the least node of its component.

    First a node keeps the edge to its least neighbour, and its other lesser
    neighbours take an edge to that one, so trees of many tasks over the same nodes
    become one tree; where all of these are stars, they are the result.  Otherwise
    each round takes the least label of a node's neighbours, then the label's own
    label, so paths halve.  Every round is written to the shared folder.  Least
    labels are summed up before they are shuffled, so a node of any degree is no
    hot key.  Edges should come from trees, so that a node has few lesser
    neighbours, such as one for each task; any number of greater ones is fine.
    """
    pairs = edges.select(F.greatest(one, other).alias("x"), F.least(one, other).alias("y")).where("x <> y")
    least = pairs.groupBy("x").agg(F.collect_set("y").alias("ys")).withColumn("low", F.array_min("ys"))
    pairs = least.select(F.explode(F.expr("transform(ys, y -> if(y = low, x, y))")).alias("x"), F.col("low").alias("y")).distinct()
    pairs = written(pairs, "edges")
    if not pairs.join(pairs.select(F.col("y").alias("x")), "x", "left_semi").take(1):
        return pairs.unionByName(pairs.select(F.col("y").alias("x"), "y").distinct()).select(F.col("x").alias("node"), F.col("y").alias("label"))
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    labels = written(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = written(hooked.join(own, "label").select("node", F.least("label", "above").alias("label"), "old"), "labels")
        labels = new.select("node", "label")
        if not new.where("label <> old").take(1):
            return labels
    raise RuntimeError("components did not settle")
