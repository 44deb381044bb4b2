"""What is linked by weighted edges, in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.session import written


def linked(pairs: DataFrame) -> DataFrame:
    """(node, cluster) for each node with an edge (a, b, away); the cluster's number is its smallest node.

    Average linkage on the sparse graph: the distance of two clusters is the mean of the edges between them. All edges are
    within the threshold, so means are, and the rounds stop when no edge is left.

    In each round every cluster names its best neighbour, and all mutual best pairs, each with everything whose chain of
    names leads to it, merge in parallel; chains are shortened by pointer jumping. Every cluster with an edge merges in each
    round, so their number at least halves. Ties between equally near neighbours are broken by a hash of the pair.

    Edges and labels are written after each round, so a lost executor costs one round; the rounds end when no edge is left.
    """
    edges = written(pairs.select("a", "b", F.col("away").cast("double").alias("away"), F.lit(1).cast("bigint").alias("n")), "edges")
    label = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("cluster", F.col("node")), "labels")
    while edges.take(1):
        order = F.struct((F.col("away") / F.col("n")).alias("mean"), F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).alias("h"), F.col("b").alias("to"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "away", "n"))
        best = written(both.groupBy("a").agg(F.min(order).alias("best")).select(F.col("a").alias("c"), F.col("best.to").alias("to")), "best")
        # of a mutual pair the smaller member is the root; every other cluster points at its best neighbour
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        root = (F.col("back") == F.col("c")) & (F.col("c") < F.col("to"))
        moves = written(best.join(back, "to").select("c", F.when(root, F.col("c")).otherwise(F.col("to")).alias("new")), "moves")
        while True:
            step = moves.select(F.col("c").alias("new"), F.col("new").alias("next"))
            jumped = written(moves.join(step, "new").select("c", F.col("next").alias("new"), (F.col("next") != F.col("new")).alias("moved")), "moves")
            moves = jumped.select("c", "new")
            if not jumped.where("moved").take(1):
                break
        ma, mb = moves.select(F.col("c").alias("a"), F.col("new").alias("na")), moves.select(F.col("c").alias("b"), F.col("new").alias("nb"))
        moved = edges.join(ma, "a").join(mb, "b").where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "away", "n")
        edges = written(moved.groupBy("a", "b").agg(F.sum("away").alias("away"), F.sum("n").alias("n")), "edges")
        label = written(label.join(moves.select(F.col("c").alias("cluster"), "new"), "cluster", "left").select("node", F.coalesce("new", "cluster").alias("cluster")), "labels")
    smallest = label.groupBy("cluster").agg(F.min("node").alias("least"))
    return label.join(smallest, "cluster").select("node", F.col("least").alias("cluster"))
